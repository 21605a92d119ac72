"""Derived inputs, registered queries and their SQL oracles."""
