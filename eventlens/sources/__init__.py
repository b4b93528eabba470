"""Readers of raw logs and timeline files, and writers."""
