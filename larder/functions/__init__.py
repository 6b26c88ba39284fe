"""Functions of the food-catalog engine."""
