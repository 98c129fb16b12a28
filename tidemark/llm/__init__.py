"""Operators for preparing training text. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions travel to executors with their code, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
