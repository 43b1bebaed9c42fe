"""Once-per-file loads as streams over a folder."""
