"""Prepare, score and analyse labelled image-text samples with Spark DataFrames."""

__version__ = "0.1.0"
