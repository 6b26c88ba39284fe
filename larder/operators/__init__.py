"""Operators of the food-catalog engine."""
