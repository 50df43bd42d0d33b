"""Column expressions: format patterns, validators, types, the rule compiler."""
