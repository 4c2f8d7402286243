"""spindrift: Spark-native analytics for sampled signals, event trains and text corpora."""

__version__ = "0.1.0"
