"""Readers of landed feeds and tables, writers of tables and reports."""
