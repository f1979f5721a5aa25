"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries.py`` registers its
queries and ``__spark_entry__`` adds them only where the subpackage exists.
"""
