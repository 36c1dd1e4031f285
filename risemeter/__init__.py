"""Audience-growth analytics as PySpark DataFrame operators."""
