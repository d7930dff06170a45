"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; removing the folder leaves the rest of the library whole.
"""
