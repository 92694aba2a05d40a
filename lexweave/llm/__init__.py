"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it. Worker functions are shipped by value, so executors
need only the public libraries they use and not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
