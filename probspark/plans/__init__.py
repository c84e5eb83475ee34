"""Probabilistic circuits as plans: nodes, validation, rewrites, persistence, and their two lowerings."""
