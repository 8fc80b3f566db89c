"""arcwell: labelled-graph queries on PySpark."""
