"""DataFrame operators: ingestion, models, identity, signals, scoring, assignment, views, audit, evaluation."""
