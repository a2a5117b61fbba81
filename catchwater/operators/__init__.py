"""Operators over cell tables."""
