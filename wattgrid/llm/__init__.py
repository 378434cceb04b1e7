"""Training-data operators: tokenizing, mixing, deduplication, formatting, extraction and filters.

Functions of this package travel to the executors by value, so that these need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
