"""Analytics over keyed daily series, expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so that executors don't need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
