"""Operators for training-data pipelines. Nothing else in the library imports
this package; queries are listed in :mod:`tarnweb.llm.registry`."""
