"""Operators for training data; optional, nothing else imports them."""
