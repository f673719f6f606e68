"""Whole jobs: corpora, task pipelines, registered queries."""
