"""Readers, writers and the derived business records that the queries run on."""
