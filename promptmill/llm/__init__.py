"""Operators for training-data pipelines: mixing, search, deduplication, scoring, tokenizing, cleaning.

Nothing else in the library imports this package. Its functions reach executors as code
(pickled by value), so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
