"""logweave: partition-log analytics and relational operators on PySpark."""

__version__ = "1.0"
