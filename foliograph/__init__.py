"""Document-graph analytics on PySpark."""
