"""Readers of landed payloads and seed lists, and table writers."""
