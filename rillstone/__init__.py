"""A PySpark engine that turns change feeds into versioned, queryable tables and keeps their history."""

__version__ = "0.1.0"
