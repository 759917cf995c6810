"""Training, tuning, scoring and bookkeeping of tree-ensemble classifiers.

Functions that run in Python workers are shipped with their code, so workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
