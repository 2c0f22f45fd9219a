"""Operators composed into whole evaluations."""
