"""Operators that prepare training data from indexed code and its documents."""
