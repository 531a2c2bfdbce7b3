"""Operators of the survey-catalog library."""
