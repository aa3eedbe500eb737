"""Entity-pair screening on Spark DataFrames.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (scans and sinks) and ``plans`` (whole jobs composed
from operators).
"""
