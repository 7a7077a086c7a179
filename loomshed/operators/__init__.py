"""Relational operators that Spark lacks, as compositions of DataFrame operations."""
