"""Operators for preparing training data: decontamination, quality, sharding,
mixing, nearest neighbours, URL filters, token counts, line dedup, n-gram
similarity and chat formatting. Nothing else in the library imports this."""
