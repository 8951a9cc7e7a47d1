"""Merges kept up to date over streams."""
