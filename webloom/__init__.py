"""Crawl-catalogue, search and training-data analytics on PySpark."""
