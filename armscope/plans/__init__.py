"""Whole analyses and the catalogue of runnable queries with their SQL twins."""
