"""Operators of the training-data problems tagged llm. Nothing outside this package imports it."""
