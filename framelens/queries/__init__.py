"""Queries over the driver's tables, one for each operator, with the SQL that they are held against."""
