"""Operators for training-data preparation."""
