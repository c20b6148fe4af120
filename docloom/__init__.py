"""docloom: document preparation and vector search as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside tasks travel with the job, so executors
# need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
