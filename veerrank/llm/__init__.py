"""Operators for preparing training text: each module holds one operator with its own general interface."""
