"""Training-data operators: one module per operator, ``registry`` lists their queries."""

import sys

from pyspark import cloudpickle

# task functions travel by value: executors need no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
