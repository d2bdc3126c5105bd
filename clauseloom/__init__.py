"""Spark-native engine for semi-structured agreement text."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Kernels travel to the executors by value, so that a cluster needs no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
