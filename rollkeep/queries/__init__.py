"""The registered queries by family: each module has QUERIES and SQL."""
