"""Registered queries: each module adds Spark plans and their SQL counterparts to the registry."""
