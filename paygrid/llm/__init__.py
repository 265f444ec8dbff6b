"""Operators of the training-data pipeline; nothing else in the library imports this package.

Functions of this package that Spark ships to tasks are pickled by value, so
executors need numpy, pyarrow and the named libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
