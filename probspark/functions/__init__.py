"""Statistics, transforms and counter-based random numbers as Column and DataFrame functions."""
