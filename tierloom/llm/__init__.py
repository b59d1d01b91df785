"""Training-data operators: dedup, filters, formatting, mixing, scans.

Nothing else in the library imports this package; ``__spark_entry__.py``
adds its queries when it is present.

Tasks carry the package's functions along by value, so executors need only
the public libraries that it imports, not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
