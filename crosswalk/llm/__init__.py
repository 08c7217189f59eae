"""Operators for building training data from large text tables. Nothing else in the library imports this subpackage."""
