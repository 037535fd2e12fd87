"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage; its queries are in
``affinis.llm.queries`` and are added by ``__spark_entry__.py`` when present.
"""
