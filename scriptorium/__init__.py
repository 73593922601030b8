"""scriptorium — transcript quality and review as Spark jobs."""

import sys

from pyspark import cloudpickle

# tasks carry the code itself, so workers need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
