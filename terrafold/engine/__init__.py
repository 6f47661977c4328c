"""Operator graphs: registry, JSON, initialisation and queries."""
