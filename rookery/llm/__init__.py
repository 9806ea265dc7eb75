"""Operators for training-data pipelines over posts and documents."""
