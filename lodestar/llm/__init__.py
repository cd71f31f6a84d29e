"""Operators of a training-data pipeline: ten DataFrame -> DataFrame components.

Nothing else in the package imports this subpackage; ``registry`` lists its queries.
"""
