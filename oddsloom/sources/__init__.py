"""Venue feeds in, one market model out."""
