"""Talkloom: dialogue-corpus analytics expressed as Spark plans."""
