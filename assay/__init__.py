"""Spark-native typed decisions: scoring, calibration, evaluation and dataset engineering as DataFrame operators."""
