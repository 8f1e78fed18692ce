"""PySpark library of jobs that curate a research-paper corpus and the dataset links in it.

Every operator is a function from DataFrame to DataFrame (or Column to Column).
"""

import sys

from pyspark import cloudpickle

# Arrow functions travel by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
