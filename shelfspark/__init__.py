"""Retail price tracking and corpus preparation as DataFrame programs."""

import sys

from pyspark import cloudpickle

# functions of this package travel with the jobs that use them: executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
