"""Spark-native analytics over pose time series and training-data corpora.

Functions of this package travel to the executors by value, so that these need
not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
