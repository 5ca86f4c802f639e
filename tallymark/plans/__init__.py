"""Queries composed from the operators, each with its SQL twin."""
