"""Statistics of at-least-once message delivery on Spark.

``operators`` hold the fold and the percentiles, ``plans`` the named queries,
``sources`` and ``sinks`` the ways in and out, ``functions`` column helpers and
``streaming`` the continuous jobs.
"""

from oncemore.operators.fold import fold
from oncemore.operators.percentiles import nearest_rank_percentiles

__all__ = ["fold", "nearest_rank_percentiles"]
