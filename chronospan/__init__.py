"""Temporal event analytics as Spark jobs: event programs, as-of evidence, retrieval and evaluation."""
