"""Training-data operators: mixing, tokens, search, fingerprints, joins, binary output, dedup, language, web archives."""
