"""Names, patterns and tables that results depend on."""
