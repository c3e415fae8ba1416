"""Catalog enrichment analytics on Spark: profile, describe, review, import, audit."""
