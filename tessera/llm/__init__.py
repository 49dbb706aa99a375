"""Training-data operators: language ID, quality, secrets, tokens, dedup, licences, LM, shards, decontamination, URLs."""
