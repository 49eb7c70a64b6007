"""Sparkfolio: literature analytics as PySpark DataFrame operators."""
