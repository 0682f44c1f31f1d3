"""Reading and writing line tables, stage tables and report files."""
