"""Operators for cleaning and scoring text corpora at scale.

One module per operator; ``queries.py`` registers them.  Nothing outside
this folder imports it.
"""
