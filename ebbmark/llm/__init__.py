"""Operators for preparing training text at scale. Nothing else in ebbmark imports this subpackage."""
