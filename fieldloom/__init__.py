"""Operational-data analytics on Spark: catalogues, matching, logs, manifests, diffs."""
