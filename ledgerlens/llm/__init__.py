"""Training-data operators: fingerprints, PII, deduplication, quality, language, tokens, media, mixing."""
