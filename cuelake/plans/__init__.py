"""Derived views and the registry of named queries with their SQL twins."""
