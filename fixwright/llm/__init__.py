"""Operators for preparing training text: scoring, filtering, matching, counting, mixing and placing documents."""
