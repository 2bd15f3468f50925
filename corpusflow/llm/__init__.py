"""Operators of a large-scale training-data pipeline.

One module per operator; ``queries`` registers them.  Nothing outside this
subpackage imports it.
"""
