"""Symbols and imports of source files, found with column expressions and windows.

Text is read once per file: comments and strings are blanked, lines become small
rows of numbers and names, and windows over those rows give depth, ends and owners.
No line of text is shuffled; signatures and documentation are cut out of the file
after the ranges are known.
"""
