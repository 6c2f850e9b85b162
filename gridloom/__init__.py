"""gridloom: a Spark-first analytics engine for changing registers."""

__version__ = "0.1.0"
