"""Plans of the food-catalog engine."""
