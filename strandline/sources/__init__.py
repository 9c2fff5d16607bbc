"""Readers of scopes, exclusions and fact tables, and writers of results."""
