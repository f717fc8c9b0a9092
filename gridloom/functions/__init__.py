"""Scalar types and column functions of the array engine."""
