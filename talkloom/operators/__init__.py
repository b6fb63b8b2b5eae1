"""Talkloom operators."""
