"""Operators over documents: structure, rules, comparison, comments, revision and reports."""
