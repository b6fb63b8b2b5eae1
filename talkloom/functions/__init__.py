"""Talkloom functions."""
