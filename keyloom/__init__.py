"""Keyframed-track analytics as Spark DataFrame operators."""
