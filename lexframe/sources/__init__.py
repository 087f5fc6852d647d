"""Readers: scraped JSONL, HTML trees, text files, year seeds, stand-in views."""
