"""Polynomials, semirings, sketches and layer statistics."""
