"""tidemark: ordered, geo-referenced and multivariate time series on PySpark.

Every operator is a ``DataFrame -> DataFrame`` function.  Facts are reduced to
calendar series with map-side aggregation first; whole-series algorithms then
run on groups whose length the calendar bounds.  Observation-level series, which
have no such bound, go through :mod:`tidemark.operators.blocked`.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from tidemark.session import build_session, cut_lineage

__all__ = ["build_session", "cut_lineage"]

# Functions shipped to Python workers travel with the plan, so executors need no install of this package.
register_pickle_by_value(sys.modules[__name__])
