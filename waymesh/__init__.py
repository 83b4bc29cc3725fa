"""A PySpark-native engine for road-network, routing and map-record analytics."""

__version__ = "0.1.0"
