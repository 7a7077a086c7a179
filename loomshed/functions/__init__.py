"""Column functions that Spark lacks or names otherwise."""
