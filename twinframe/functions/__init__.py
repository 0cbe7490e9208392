"""Scalar column expressions and type rules."""
