"""Spark jobs for bank-statement ingestion, reconciliation and corpus preparation."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so that executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
