"""Spark-native retrieval, corpus preparation and evaluation engine."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so that executors need
# only numpy and pyarrow, not an installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
