"""reconloom: record linkage, conservative metadata merging and corpus preparation on PySpark."""

__version__ = "0.1.0"
