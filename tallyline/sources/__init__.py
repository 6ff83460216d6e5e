"""Readers for raw files, stored tables and the sample tables."""
