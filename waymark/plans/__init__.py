"""Composite plans: the journey planner and place search."""
