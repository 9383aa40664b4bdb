"""Queries over the driver's tables, each beside the SQL that says what it must return."""
