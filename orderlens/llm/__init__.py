"""Operators on text for training data, each built by one named method; nothing else imports them."""
