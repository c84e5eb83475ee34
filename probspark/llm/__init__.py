"""Training-data operators: chat formatting, language id, quality, URL filters, PII, language-model
scoring, decontamination, fingerprints, near-duplicates and subword encoding, as Spark jobs.

Nothing else in the package imports this subpackage.
"""
