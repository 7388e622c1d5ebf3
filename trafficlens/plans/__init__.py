"""Whole jobs, the query catalog and the SQL that checks it."""
