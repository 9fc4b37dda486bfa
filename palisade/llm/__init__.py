"""Operators that prepare training text and vectors. Nothing outside this folder imports it."""
