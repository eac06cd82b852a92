"""The query catalogue: operators composed into named queries with their SQL oracles."""
