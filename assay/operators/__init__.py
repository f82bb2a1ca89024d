"""Relational operators over inventory, verdict log, catalog, scans and queue."""
