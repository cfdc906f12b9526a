"""Readers of filings, pages and feeds."""
