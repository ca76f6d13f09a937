"""Operators for training-data pipelines: ten components, each built by one named method.

Nothing else in the library imports this subpackage.
"""
