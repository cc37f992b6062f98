"""Corpus operators for training data: the rest of the library never imports this subpackage."""
