"""Batch preparation of embedding and text corpora on Spark.

Everything takes and returns DataFrames; the session is always the caller's.
"""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so worker nodes need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
