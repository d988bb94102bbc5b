"""cratewave: a PySpark-native analytics engine for music-library data."""

__version__ = "0.1.0"
