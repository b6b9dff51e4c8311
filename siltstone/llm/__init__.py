"""Operators for building language-model training data at scale.

Nothing else in the library imports this subpackage; ``entries`` lists its
queries for the driver entry point.
"""
