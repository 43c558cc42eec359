"""Column-level functions (no DataFrame in, no DataFrame out)."""
