"""Streaming use.

There is no stream operator to offer: the operators that look at one row at a
time (``operators.filters.length_range``, ``operators.filters.label_window``,
``functions.sequences.*``) are plain column expressions and accept a
``readStream`` DataFrame as they are; everything else needs whole-table counts.
"""
