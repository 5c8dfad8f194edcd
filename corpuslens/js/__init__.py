"""JavaScript: a parser to ESTree-like dicts and a visitor that turns a syntax tree into fact rows."""

from .facts import FileFacts, inspect
from .parser import JsSyntaxError, parse

__all__ = ["FileFacts", "JsSyntaxError", "inspect", "parse"]
