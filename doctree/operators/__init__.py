"""Operators on tables of pages, items and nodes."""
