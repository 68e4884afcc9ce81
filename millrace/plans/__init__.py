"""Catalogue of queries and of the SQL that gives the same results."""
