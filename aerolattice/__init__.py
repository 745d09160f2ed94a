"""Airspace planning and artifact lineage as Spark DataFrame operators."""
