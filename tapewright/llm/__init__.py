"""Operators over training-text tables; nothing outside this subpackage imports it."""
