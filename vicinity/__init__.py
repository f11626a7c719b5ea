"""vicinity: set-oriented similarity search and vector analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in workers travel with their module's contents, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
