"""Posting-corpus analytics as composable PySpark DataFrame operators."""
