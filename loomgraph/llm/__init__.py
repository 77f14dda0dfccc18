"""Operators for preparing large text corpora; nothing else in loomgraph imports this."""
