"""Micro-batch inserts."""
