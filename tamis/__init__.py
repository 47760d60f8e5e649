"""Spark operators for collecting, cleaning, de-duplicating, classifying and delivering job postings."""

import sys

from pyspark import cloudpickle

# The few functions that run inside tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
