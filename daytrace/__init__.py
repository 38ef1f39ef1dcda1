"""Activity-log analytics on Spark: sessions, observations, statement merging and scoring."""

import sys

from pyspark import cloudpickle

# Ship the small Python helpers with the tasks that use them, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
