"""Streaming of the survey-catalog library."""
