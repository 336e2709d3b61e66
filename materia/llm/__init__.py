"""Training-data operators: packing, filtering, deduplication, mixing, extraction.

Nothing outside this subpackage imports it; the registry in ``queries.py`` is
picked up by ``__spark_entry__.py`` when the subpackage is present.
"""
