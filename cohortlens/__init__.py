"""Classifier-evidence analytics as Spark DataFrame operators."""
