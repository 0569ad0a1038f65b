"""Hybrid retrieval, evidence ranking and conversation tables as Spark jobs."""

import sys

from pyspark import cloudpickle

# The small functions that run in Python workers travel with their tasks, so that executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
