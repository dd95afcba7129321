"""Registered queries (one per SURVEY section 2 operator that can run on the
shared test tables) and their DuckDB oracle twins."""
