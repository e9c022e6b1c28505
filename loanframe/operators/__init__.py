"""Reusable DataFrame -> DataFrame operators that stay bounded under skew."""
