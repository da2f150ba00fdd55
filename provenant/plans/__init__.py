"""Derived inputs and the catalogue of registered queries."""
