"""Talkloom sources."""
