"""Queries over circuits and the learning of circuits."""
