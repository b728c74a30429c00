"""Column expressions: parsing, tokens, prompts, classification, rendering, names, patterns."""
