"""Event-form analytics as lazy Spark plans: tables of entities that take part in ordered batches."""
