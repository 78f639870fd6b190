"""Column helpers and distribution functions."""
