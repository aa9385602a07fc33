"""Training-data operators: media, secrets, tokens, quality, language models, joins, archives, mixing, repeats, toxicity."""
