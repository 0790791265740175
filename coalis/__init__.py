"""Coalis: a PySpark-native engine that correlates security findings.

Everything is expressed as DataFrame plans.  Python only appears where Spark has no
built-in: BLAKE3, the PURL and CPE grammars, long-text similarity and the order-dependent
complete-link merge, always in Arrow batches.
"""

__all__ = ["config", "functions", "operators", "plans", "sources", "streaming"]
