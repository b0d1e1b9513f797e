"""Operators that prepare training text: quality, duplicates, leaks, licenses, tokens, chats and URLs."""
