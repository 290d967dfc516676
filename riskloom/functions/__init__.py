"""Column functions. All but Jaro-Winkler are compositions of Spark built-ins."""
