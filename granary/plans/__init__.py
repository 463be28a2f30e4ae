"""Queries over the driver's tables, each with the SQL that another engine runs for comparison."""
