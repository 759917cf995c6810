"""Operators for preparing training data: ten jobs on documents, vectors and web pages.

Functions that run in Python workers are shipped with their code, so a cluster needs the libraries they
use (numpy, pyarrow and so on) but no copy of this package on its workers' paths.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
