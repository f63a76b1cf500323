"""Traces of streaming transcription: metrics, contract checks and summaries, stored or live."""
