"""Streams of scan progress and triage results."""
