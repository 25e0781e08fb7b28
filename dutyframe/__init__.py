"""Dated, provenance-tracked records on Spark: parsing, normalizing, resolving, serving."""
