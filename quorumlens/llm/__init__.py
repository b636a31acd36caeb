"""Operators of a training-data pipeline: one module for each operator, ``queries`` registers them."""
