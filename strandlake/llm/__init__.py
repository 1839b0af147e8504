"""Operators for preparing training text, one module per operator.

Nothing outside this package imports it; ``catalog`` lists its queries.  Functions of the package are sent to the
executors by value, so only the driver needs it on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
