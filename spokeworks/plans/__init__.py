"""From landing files to rides, marts and reports."""
