"""Training-data operators: dedup, scans, scoring, decontamination, archives, packing.

Nothing outside this subpackage imports it. ``QUERIES`` holds one query per
operator (``tessera.llm.queries``) plus the corpus pipeline.
"""
