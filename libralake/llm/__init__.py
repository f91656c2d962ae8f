"""Training-data operators: deduplication, fingerprints, token codecs, scans, extraction, classification.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; ``queries.py`` holds the thin ``opN_*`` queries over the tables.
"""
