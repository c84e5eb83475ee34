"""Readers and preparation of data matrices."""
