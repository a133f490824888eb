"""Operators for preparing large text corpora.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries only when it can be imported.
"""
