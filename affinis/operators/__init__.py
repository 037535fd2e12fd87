"""Relational operators of the linkage, from record profiles to decisions."""
