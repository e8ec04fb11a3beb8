"""Plans: SQL, column selectors, inspection."""
