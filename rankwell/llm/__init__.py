"""Training-data operators: tokens, media, search, quality, dedup, mixing, packing, pages.

Nothing else in the library imports this subpackage.
"""
