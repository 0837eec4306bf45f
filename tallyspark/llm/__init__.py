"""Operators for preparing training data: duplicates, quality, leaks, tokens, chats, licences and toxicity."""
