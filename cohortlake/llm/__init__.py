"""Operators for preparing training data at scale, with their queries in ``queries``."""

import sys

from pyspark import cloudpickle

# what tasks run travels with them: executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
