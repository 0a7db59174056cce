"""Inkatlas: a Spark engine for character priors, vector ranking, evaluation slices and record grouping.

Functions shipped to executors are pickled by value, so a cluster's workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
