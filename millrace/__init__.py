"""Keyed-stream processing on Spark: routing, admission, framing, folds,
handlers with dead letters, elastic scaling and audits, over DataFrames and
Structured Streaming."""
