"""Plans of whole queries."""
