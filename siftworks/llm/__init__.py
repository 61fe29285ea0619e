"""Operators of a training-data pipeline: quality, archives, tokens, rules, chat, fingerprints, dedup, secrets, mixing."""
