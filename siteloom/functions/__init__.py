"""Column functions: URLs, text and vocabularies. All are built-in expressions and stay in whole-stage code generation."""

from siteloom.functions import text, urls, vocab

__all__ = ["text", "urls", "vocab"]
