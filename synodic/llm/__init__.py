"""Training-data operators over text and vectors; nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

# functions go to the executors whole, so that these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
