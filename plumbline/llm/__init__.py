"""Operators on texts and records for training data. Nothing outside this subpackage imports it."""
