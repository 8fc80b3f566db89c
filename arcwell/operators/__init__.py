"""Relational building blocks over solution rows."""
