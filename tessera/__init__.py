"""Spark-native analytics for imaging records: grids, journals, votes, spectra and registration tables."""
