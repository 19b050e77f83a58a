"""Spark jobs that audit measurements gathered from many papers by many sources."""
