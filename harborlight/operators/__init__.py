"""Joins, matching and ordered operators."""
