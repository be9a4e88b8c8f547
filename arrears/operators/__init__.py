"""DataFrame -> DataFrame operators: validation, scorecards, lookups,
as-of replay, features, models and the scoring cascade."""
