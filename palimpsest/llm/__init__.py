"""Operators for building training data, each a module of its own; nothing else in the library imports them."""
