"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage. Task functions travel to
the executors as code, so the package need not be installed there.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
