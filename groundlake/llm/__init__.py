"""Operators for large training-data pipelines; nothing else in groundlake imports this subpackage."""
