"""Grammars of the supported languages."""
