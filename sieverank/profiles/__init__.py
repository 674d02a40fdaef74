"""Domain content as data: columns, bounds, rules and templates."""
