"""Operators of a training-data pipeline, on the tables documents, pages and
labels. Nothing outside this package imports it; ``queries`` holds the thin
registered queries.

Functions of this package that run in tasks are sent with the task, so
executors need no copy of the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
