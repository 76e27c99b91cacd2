"""Readers of payload tables, rule tables and stored pages, and log writers."""
