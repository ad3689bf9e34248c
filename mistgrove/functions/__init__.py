"""Column functions: table lookups, fuzzy memberships and impurities."""
