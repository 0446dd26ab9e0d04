"""Operators on element, group, fetch, robots and link tables."""
