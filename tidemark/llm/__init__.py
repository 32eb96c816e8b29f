"""Operators on texts and entities for training data. Nothing outside of this subpackage imports it."""
