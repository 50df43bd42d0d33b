"""Structured Streaming versions of the algebraic profile."""
