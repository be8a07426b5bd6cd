"""fianchetto: chess-archive analytics as Spark DataFrame operators.

Every operator is either a ``Column -> Column`` function (``fianchetto.functions``)
or a ``DataFrame -> DataFrame`` transform (``fianchetto.operators``), so it can be
chained with ``df.transform`` and optimised by Catalyst as one plan.
"""

__version__ = "0.1.0"
