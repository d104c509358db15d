"""Operators for preparing training text, each by its own method; nothing else imports this package."""
