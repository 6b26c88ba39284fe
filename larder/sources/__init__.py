"""Sources of the food-catalog engine."""
