"""Query registry over the test tables, with a DuckDB twin where SQL can express it."""
