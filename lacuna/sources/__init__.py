"""Readers of messy delimited files, sectioned sheets, snapshots and markup; writers of results."""
