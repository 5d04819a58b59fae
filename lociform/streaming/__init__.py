"""Incremental forms of additive genotype aggregates over streams of cells."""
