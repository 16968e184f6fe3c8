"""Readers, writers and the rating views over the star-schema tables."""
