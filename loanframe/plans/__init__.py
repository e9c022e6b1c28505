"""The data flows: statements, profiles, loans, models, cases, records."""
