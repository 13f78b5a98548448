"""Readers and writers of transcripts, corpus tables, votes, tokens and results."""
