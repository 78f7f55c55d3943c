"""Operators for large text corpora: dedup, filters, scans, mixing, sharding, search.

Nothing outside this subpackage imports it. Its functions travel to executors by
value, so a cluster needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
