"""Structured Streaming forms of the append-style sinks.

The analytical datasets are batch DataFrame plans. The one inherently
incremental flow is product returns: returned order lines arrive over time, are
validated against sales, appended to the returns table, and turned into e-mail
payloads. ``returns.start_returns_stream`` runs that as a streaming query.
"""
