"""Queries over the test tables, and SQL to hold them against."""
