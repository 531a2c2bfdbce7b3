"""Functions of the survey-catalog library."""
