"""Tiled vector-map analytics and data-maintenance operators on Spark."""

__version__ = "0.2"
