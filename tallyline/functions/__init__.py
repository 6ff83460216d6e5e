"""Column expressions shared by ingestion and reports."""
