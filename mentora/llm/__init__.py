"""Operators of a training-data pipeline: media, tokens, packing, quality, overlap, language model, chat and privacy."""
