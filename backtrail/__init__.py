"""Backward variable lineage over program graphs, expressed as Spark DataFrame plans."""
