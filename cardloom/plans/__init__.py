"""Registered queries. Each module has QUERIES (name to function) and SQL (name to the same result in plain SQL)."""

MODULES = ("references", "uploads", "cards", "changes", "work", "rules", "builtin")
