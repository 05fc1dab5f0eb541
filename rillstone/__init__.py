"""rillstone: a Spark-first engine for preparing and analysing sequence corpora.

The package is pickled by value, so that executors need no copy of it on
their Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
