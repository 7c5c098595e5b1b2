"""Operators for training text: repeated lines, percentiles, splitting, near-duplicates, scanned text,
token ids, leaked evaluation items, personal information. Nothing outside this package imports it."""
