"""Table files, their schemas, and Parquet stand-ins."""
