"""Readers, writers and the adapter from order and event tables to a panel."""
