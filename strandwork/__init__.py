"""Sequence-table preparation and model evaluation as Spark DataFrame operators."""
