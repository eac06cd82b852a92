"""Column functions: rewrite rules, transliteration, names, keys, units, bracket scanning."""
