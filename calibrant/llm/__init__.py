"""Operators for large text corpora: archives, tokens, chat, packing, quality, links and duplicates.

Nothing else in the library imports this subpackage.
"""
