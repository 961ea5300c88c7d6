"""Training-data operators: packing, token counts, quality, dedup, scoring.

Functions of this subpackage that run in Python workers are sent to them by
value, so that executors need no copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
