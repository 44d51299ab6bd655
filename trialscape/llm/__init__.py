"""Operators that prepare text and vectors for training: each module is one operator, ``queries`` registers them."""
