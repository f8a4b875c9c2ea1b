"""Decoy-sensor log analytics as composable Spark DataFrame transformations."""
