"""Readers and writers of traces."""
