"""Queries over the test tables and the SQL that gives the same answers."""
