"""Training-data operators: extraction, quality, language, deduplication, chat, mixing.

Nothing outside this subpackage imports it.  ``queries`` and ``oracle_sql`` of
:mod:`wayfold.llm.registry` are what ``__spark_entry__`` adds.
"""
