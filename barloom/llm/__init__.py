"""Operators for preparing large text, vector and web corpora. Nothing outside this folder imports it."""
