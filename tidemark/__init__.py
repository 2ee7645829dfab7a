"""tidemark: incremental and relational analytics on PySpark."""
