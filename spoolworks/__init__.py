"""Spark-native analytics for media catalogues: shredding, profiling, resolution, sampling and question scoring."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to the executors by value, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
