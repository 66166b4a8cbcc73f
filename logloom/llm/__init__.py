"""Training-data operators: scoring, near and exact dedup, mixing, packing,
filters and scans.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need
# only numpy, pyarrow, xxhash and tokenizers, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
