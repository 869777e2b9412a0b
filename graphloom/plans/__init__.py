"""Composed reports, bindings of the driver's tables, and the query catalogue."""
