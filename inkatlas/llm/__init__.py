"""Operators for preparing training corpora: grouping, search, splits, overlap, packing, mixing, repair."""
