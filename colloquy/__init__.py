"""Conversational-memory analytics as plain PySpark jobs."""
