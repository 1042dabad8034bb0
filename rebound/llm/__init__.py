"""Training-data operators: mixing, sharding, language ID, deduplication, secrets, BPE, WARC, fingerprints, top-k,
tokenizer alignment, whitening."""
