"""Claims forensics on PySpark: cleaning, relational screening and statistics as DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
