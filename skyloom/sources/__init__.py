"""Sources of the survey-catalog library."""
