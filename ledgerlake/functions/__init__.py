"""Column expressions: text to types, calendars, enrichment rules."""
