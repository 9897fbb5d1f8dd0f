"""Training-data operators: dedup, quality, fingerprints, URL filters, joins,
token files, packing, language-model scores, byte-level BPE and PII.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` depends on it.
"""
