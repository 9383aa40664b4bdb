"""Training-data operators and the corpus pipeline's stages; nothing else in the library imports this."""
