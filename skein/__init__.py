"""skein: clustered vector retrieval and large-table data processing on PySpark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so that no copy of this package is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
