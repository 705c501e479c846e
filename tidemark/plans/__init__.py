"""Registered queries and verdict pipelines."""
