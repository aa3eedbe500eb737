"""Operators for preparing training text: language, quality, near-duplicates,
mixing, packing and scoring. Nothing outside this package imports it."""
