"""Relational operators over postings, canonical jobs, requests and events."""
