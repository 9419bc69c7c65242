"""Spark jobs over issue reports: ingest, clean, rules, samples, labels, metrics, decisions, streams."""
