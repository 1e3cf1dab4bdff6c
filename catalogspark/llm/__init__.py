"""Operators for training-data corpora; nothing outside this folder, its tests and the pipeline uses it."""
