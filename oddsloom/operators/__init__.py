"""Relational operators on markets, outcomes and price snapshots."""
