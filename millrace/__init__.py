"""Spark-native engine for building, cleaning and auditing text corpora.

Sub-packages: ``sources`` (readers and sinks), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame), ``plans`` (whole queries
and their oracle SQL) and ``streaming``.
"""

__version__ = "0.1.0"
