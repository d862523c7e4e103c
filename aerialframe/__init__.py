"""aerialframe: survey analytics over drone photo metadata, as DataFrame functions."""
