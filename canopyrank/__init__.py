"""Spark-native taxonomy, rating and corpus analytics."""

import sys

from pyspark import cloudpickle

# functions reach executors whole, so that these need no copy of the package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
