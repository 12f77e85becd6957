"""Arborlake: a Spark-native analytics engine for semi-structured record collections."""

__version__ = "0.1.0"
