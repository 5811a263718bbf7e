"""mathquarry: a PySpark-native engine for mining mathematical articles.

Prose, LaTeX and MathML become typed DataFrames, sparse matrices in long
(coordinate) form, models and reports.  Everything is declared with the
DataFrame API; Python runs only where text has to be parsed.
"""

import sys

from pyspark import cloudpickle

# Ship this package's functions to executors by value, so that a cluster needs
# no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
