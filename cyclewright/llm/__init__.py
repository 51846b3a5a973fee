"""Operators for preparing training text, each with its query; nothing else in the library imports this folder."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors by value, so they need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
