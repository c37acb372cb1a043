"""A PySpark-native analytics engine: plain functions from DataFrames and columns to DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code: a cluster needs no copy of this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
