"""Document intelligence over whole corpora, expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors with their code, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
