"""Retrieval-vector analytics on Spark: freeze a corpus, encode it, search it,
carry a vector index from one embedding space to another, and audit the result."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
