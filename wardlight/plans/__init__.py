"""The registered queries: operators on the given tables, each with its SQL."""
