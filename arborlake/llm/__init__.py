"""Operators for text and entity problems of training-data pipelines; nothing outside imports this subpackage."""
