"""Fixture bindings, registered queries and their SQL oracles."""
