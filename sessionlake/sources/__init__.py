"""Readers of logs, databases, services and archives."""
