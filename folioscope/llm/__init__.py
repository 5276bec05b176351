"""Operators that prepare a text corpus for training; see ``catalog`` for the registered queries."""
