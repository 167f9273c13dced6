"""Schemas, key and value functions, predicates."""
