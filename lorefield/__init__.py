"""Knowledge-base analytics on Spark: ingest, dedup, chunking, graph building and hybrid retrieval."""

import sys

from pyspark import cloudpickle

from lorefield.session import build_session, checkpointed, table

# Functions used inside Arrow tasks travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "checkpointed", "table"]
