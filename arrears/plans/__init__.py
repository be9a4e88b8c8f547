"""Query catalog (Spark) and its DuckDB oracle."""
