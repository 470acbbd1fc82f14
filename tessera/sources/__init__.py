"""Readers and writers: superblocks, pseudo-files, delta containers, tables."""
