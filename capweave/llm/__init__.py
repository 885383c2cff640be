"""Operators of a training-data pipeline; nothing else in capweave imports this subpackage."""
