"""Operators for preparing training data from code and the texts around it."""
