"""riskloom: news-risk analytics as Spark DataFrame and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# helpers that run inside tasks travel with the job, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
