"""arrears: debt-collection portfolio analytics on Spark.

Cases ("dossiers") come in as DataFrames (batch) or JSON records (stream);
everything downstream is a DataFrame -> DataFrame function so one plan
covers a whole portfolio.
"""

__all__ = ["schema", "session"]
