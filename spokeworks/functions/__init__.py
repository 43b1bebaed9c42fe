"""Column expressions shared by the staging, mart and report plans."""
