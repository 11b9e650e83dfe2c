"""Operators for text corpora used in training: splitting, repair, labelling, search, packing and mixing."""
