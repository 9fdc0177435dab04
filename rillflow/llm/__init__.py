"""Operations that a training-data pipeline needs, over tables of documents and pages.

Nothing outside this subpackage imports it. Each module holds one operator; ``queries`` holds
the thin queries that apply the operators to whole tables.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors carry their code, so the package need not be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
