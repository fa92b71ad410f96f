"""kvflow: key/value batch processing as declarative PySpark operators.

Functions that run in Python workers travel by value, and broadcasts hold plain values only (numbers, strings, arrays),
so executors need no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
