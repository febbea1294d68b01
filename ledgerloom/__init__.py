"""Artificial business records as Spark tables: made from seeded draws, checked, replayed."""
