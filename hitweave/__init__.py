"""Document-retrieval analytics as ordinary Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions sent to the tasks travel with their code: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
