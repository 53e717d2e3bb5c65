"""Queries over the supplied tables, each beside the SQL that must give the same rows."""
