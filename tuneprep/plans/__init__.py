"""Compositions: evaluate a model, prepare training batches."""
