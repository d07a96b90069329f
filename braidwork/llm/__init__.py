"""Operators for the text and record problems of training data. Nothing else in the library imports this subpackage."""
