"""shelfmark: catalog analytics and data preparation on PySpark."""
