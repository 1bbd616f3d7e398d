"""Operators for preparing training corpora; nothing else in readlake imports this subpackage."""
