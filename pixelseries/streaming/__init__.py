"""Arrivals as streams: deduplication, day composites, coverage, gaps, ledgers."""
