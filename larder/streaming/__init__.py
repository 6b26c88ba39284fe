"""Streaming of the food-catalog engine."""
