"""Profiles that stay up to date while data arrive."""
