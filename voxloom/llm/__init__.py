"""Training-data operators: near-duplicates, tokenisation, classifiers, scans, shards, language models."""
