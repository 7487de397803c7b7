"""Operators for preparing large text corpora and embedding tables for model training."""
