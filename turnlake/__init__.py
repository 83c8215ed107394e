"""A session-search engine on Spark DataFrames.

Functions that run in Python workers are shipped by value, so executors need pandas and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
