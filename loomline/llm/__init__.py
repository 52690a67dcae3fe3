"""Operators for preparing training data. Nothing else in loomline imports this subpackage."""
