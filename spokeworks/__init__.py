"""Bike-share analytics as Spark jobs: landing files to rides, marts and reports."""
