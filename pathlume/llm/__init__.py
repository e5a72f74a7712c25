"""Operators on the texts of a corpus. Nothing outside this subpackage imports it."""
