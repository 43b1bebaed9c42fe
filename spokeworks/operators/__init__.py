"""Joins, increments and quality checks shared by the plans."""
