"""tidemark: market-data analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

from tidemark.session import build_session, checkpointed, materialised, work_path

# Functions sent to Python workers travel with their code, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "checkpointed", "materialised", "work_path"]
