"""Operators of a pipeline that prepares training text; nothing else in the library imports them."""
