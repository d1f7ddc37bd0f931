"""Registered queries over the fixture tables."""
