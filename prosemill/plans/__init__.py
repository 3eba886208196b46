"""Whole queries: profiles, the rule registry, the lint plan, comparison and reports."""
