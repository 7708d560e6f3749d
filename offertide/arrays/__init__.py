"""Array work that runs in Python workers over batches of rows.

It travels with its code, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
