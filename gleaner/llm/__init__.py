"""Training-data operators: ten stand-alone components over ``documents`` and kin.

Nothing else in the package imports this subpackage.  Functions that run on
executors are shipped by value, so executors need pyspark, numpy and pyarrow but
not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
