"""Operators for preparing training text: dedup, mixing, language, packing, search and formats.

Functions that run in Python workers travel with their code, so executors need no copy of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
