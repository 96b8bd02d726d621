"""Sinks: Matrix Market and vector writers."""
