"""Rules over facts and the queries that exercise every operator on tables."""
