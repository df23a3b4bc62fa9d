"""Jobs that users run."""
