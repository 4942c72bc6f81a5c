"""Millrace: a relational query engine and data-preparation toolkit built on PySpark."""
