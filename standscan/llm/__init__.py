"""Training-data operators: archives, tokens, language, quality, links, mixing and search."""
