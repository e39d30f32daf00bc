"""Operators for preparing training data; nothing else in quillspark imports this subpackage."""
