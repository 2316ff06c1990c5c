"""Readers and writers around the engine."""

from .text import read_csv, read_sectioned_text, write_csv, write_text

__all__ = ["read_csv", "read_sectioned_text", "write_csv", "write_text"]
