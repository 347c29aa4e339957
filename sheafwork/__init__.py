"""Nested columnar analytics on Spark: shred, encode, profile and reassemble DataFrames."""

import sys

from pyspark import cloudpickle

# Worker processes get the library's functions with each task, so that a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
