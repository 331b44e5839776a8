"""Reading and writing: CSV, file sets, Parquet tables, JDBC."""
