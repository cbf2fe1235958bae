"""Spark-native engine for keeping a knowledge index honest: convergence, audit, verified search, log analytics."""

__version__ = "0.1.0"
