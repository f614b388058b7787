"""Company master-data engine: DataFrame operators for collecting, normalising,
matching, checking, segmenting and searching company records on Spark."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
