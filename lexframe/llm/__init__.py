"""Training-data operators.  Nothing outside this subpackage imports it.

Task functions are pickled by value, so executors do not need the package on
their own path."""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
