"""Operators of a training-data pipeline: one module an operator; ``queries`` registers them."""
