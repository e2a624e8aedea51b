"""Operators of a training-data pipeline; each module holds one, ``queries`` registers them."""
