"""Registered queries: each one as a Spark job over the given tables, with its SQL twin where SQL can tell the answer."""

import sys

from pyspark import cloudpickle

# The stand-in recognisers travel with their tasks, wherever the workers run.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from registry import edge, evaluation, files, inference, metadata, order, report, trees  # noqa: E402

QUERIES = {**evaluation.QUERIES, **metadata.QUERIES, **report.QUERIES, **inference.QUERIES, **files.QUERIES, **edge.QUERIES, **trees.QUERIES, **order.QUERIES}
ORACLE = {**evaluation.ORACLE, **metadata.ORACLE, **report.ORACLE, **inference.ORACLE, **files.ORACLE, **edge.ORACLE, **trees.ORACLE, **order.ORACLE}
