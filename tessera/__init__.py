"""Tessera: multi-model analytics as lazy Spark DataFrame transforms."""
