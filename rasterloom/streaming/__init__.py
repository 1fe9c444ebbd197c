"""Resumable work as ledgers and streams."""
