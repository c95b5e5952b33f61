"""Document retrieval and retrieval evaluation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Arrow helpers travel with the job, so executors need no install step.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
