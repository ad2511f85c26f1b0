"""Composed stages and the registered queries."""
