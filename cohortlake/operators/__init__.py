"""DataFrame -> DataFrame operators; keys and column names are arguments."""

import sys

from pyspark import cloudpickle

# what tasks run travels with them: executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
