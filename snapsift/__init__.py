"""Snapshot-diff analytics on Spark: element matching, diffing and reports over many page pairs at once."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that they need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
