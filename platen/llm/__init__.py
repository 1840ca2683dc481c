"""Corpus preparation at scale: dedup, packing, classifiers, fingerprints, tokens, languages and URL filters."""
