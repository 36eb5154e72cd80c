"""Operators of a training-data pipeline: ten scalable corpus operators."""
