"""Tabular machine learning on Spark: from raw text tables to scored data."""
