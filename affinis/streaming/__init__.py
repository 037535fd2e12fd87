"""Micro-batches of queries against prepared targets, and windows over events."""
