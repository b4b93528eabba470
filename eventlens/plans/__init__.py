"""Queries as values: event filters and analysis windows."""
