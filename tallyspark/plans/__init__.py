"""Queries over the driver tables, by domain; each module has QUERIES and SQL."""
