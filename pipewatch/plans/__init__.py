"""End-to-end jobs with the parameters a user passes."""
