"""Training-data operators over whole text corpora; nothing else in the package imports this."""
