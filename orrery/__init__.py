"""orrery: explore a catalogue of items, their ratings, tags, text and vectors on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in Python workers travel with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
