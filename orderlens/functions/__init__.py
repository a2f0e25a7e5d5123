"""Reusable column expressions and distributed order statistics."""
