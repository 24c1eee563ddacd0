"""Streams of events as input of the forecasting operators.

The operators themselves are batch: a lag over rows needs a whole series.
"""
