"""Operators for text corpora that feed language models. Nothing else in the library imports this package.

Functions that run in Python workers are sent by value, so that executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
