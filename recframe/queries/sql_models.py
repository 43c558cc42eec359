"""Model jobs have no SQL oracle (rows-only)."""

SQL: dict[str, str] = {}
