"""Readers for topic logs, ledgers, sink tables and progress records."""
