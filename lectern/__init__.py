"""A Spark engine that searches, links and formats semi-structured records."""

import sys

from pyspark import cloudpickle

# functions of this package travel to Python workers with their code, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
