"""Registered queries over the supplied tables and the SQL they are checked against."""
