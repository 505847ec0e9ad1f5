"""Scans, routing, change detection and table maintenance."""
