"""Spark-native analytics over conversational memory: facts, recall, lifecycle, sessions, context."""

__version__ = "0.1.0"
