from recframe.sources.tables import load_table, TABLES  # noqa: F401
