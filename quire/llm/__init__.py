"""Operators for preparing text collections for training. Nothing else imports this package."""
