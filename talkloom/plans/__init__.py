"""Talkloom plans."""
