"""Operators for preparing training corpora at scale.

Nothing outside this subpackage imports it.  Functions defined here travel to
the executors by value, so a cluster needs no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
