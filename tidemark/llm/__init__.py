"""Operators for training data: vectors, communities, tokens, leaks and cut texts. Nothing outside imports this."""
