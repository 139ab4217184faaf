"""Operators of a training-data pipeline: documents in, documents or decisions out.

Nothing else in the library imports this package. Every operator takes and returns
DataFrames, leaves other columns as they are, and works on whole texts. What a task
needs from Python is numpy over one bounded block of texts at a time.
"""
