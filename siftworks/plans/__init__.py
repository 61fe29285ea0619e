"""Derived tables and registered queries."""
