"""Operators of a training-data pipeline: language, tokens, quality, mixing, chat, duplicates, shards."""
