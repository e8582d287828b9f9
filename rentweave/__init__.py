"""Apartment-posting integration on Spark.

Postings from many sources are normalised, merged by key, linked to physical
units, tracked over time and searched, all as DataFrame operations.
"""
