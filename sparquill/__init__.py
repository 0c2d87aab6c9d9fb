"""Spark-first operators for text search, code graphs, message validation and mining."""

import sys

from pyspark import cloudpickle

# Python tasks carry the package's own functions by value, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
