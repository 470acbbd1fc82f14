"""Snapshot diff and patch as Spark plans."""

__version__ = "0.1.0"
