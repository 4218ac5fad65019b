"""Operators for preparing language-model training data, and their queries.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
when it is there.
"""
