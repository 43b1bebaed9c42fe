"""Landing files, header contracts, archives, seed and Parquet tables."""
