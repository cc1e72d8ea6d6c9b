"""shelfwise — retail customer & inventory analytics as lazy Spark DataFrame functions.

Layout:
  sources/    table readers, the canonical star-schema binding, ingest and sink helpers
  functions/  column-expression helpers (pure ``Column -> Column``)
  operators/  DataFrame -> DataFrame operators (star views, mining views, baskets,
              ranking, customer models, forecasting, inventory policy, text/search,
              serving datasets)
  plans/      the query catalog (``queries()``) and its independent DuckDB oracle
  streaming/  incremental (Structured Streaming) forms of append-style sinks
"""

from shelfwise.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
