"""Training-data operators. Their task code travels with the job, so executors need no install."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
