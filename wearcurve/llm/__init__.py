"""Operators for preparing large training corpora (self-contained subpackage)."""
