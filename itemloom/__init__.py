"""A Spark-native engine for schemaless, key-addressed item data."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to executors by value, so a cluster needs no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
