"""Ranking of items within search sessions, as PySpark DataFrame functions."""
