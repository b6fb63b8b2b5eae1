"""Talkloom streaming."""
