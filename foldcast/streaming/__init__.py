"""Bars and scores of rows that go on arriving, from file sources."""
