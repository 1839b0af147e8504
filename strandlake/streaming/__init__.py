"""Increments of reads, as batches or from files as they arrive."""
