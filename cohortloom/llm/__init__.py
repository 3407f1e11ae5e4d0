"""Operators for preparing text corpora for model training."""
