"""Operators on names, code and text for training data. Nothing outside this subpackage imports it."""
