"""Registered queries, their SQL counterparts and the fixtures both run on."""
