"""Registered queries over the given tables, and SQL that checks them."""
