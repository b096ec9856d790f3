"""Operators for language-model data: ranking, conversations, vectors, privacy, tokens, mixing, quality."""
