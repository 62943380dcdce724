"""caseflow: case-record, phrase-corpus and form-document analytics as Spark jobs.

Functions handed to Spark are pickled by value, so executors need no installed
copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
