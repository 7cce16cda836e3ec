"""Operators that prepare text for training language models. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their modules' code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
