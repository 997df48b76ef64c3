"""Knowledge retrieval and curation over text collections, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: its row helpers travel with the tasks that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
