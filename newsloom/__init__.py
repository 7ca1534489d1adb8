"""Spark-native analytics for a corpus of web articles.

Expressions live in ``functions``, table operators in ``operators``, readers and
writers in ``sources``, multi-step jobs in ``plans``, and Structured Streaming
jobs in ``streaming``.  ``catalog`` binds all of them to named queries.
"""
