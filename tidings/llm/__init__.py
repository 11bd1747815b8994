"""Operators of a training-data pipeline: near and exact duplicates, language, licences, shards,
tokens, contamination and language-model scores. Nothing outside this package imports it."""
