"""Relational operators over files, symbols, edges, commits and changes."""
