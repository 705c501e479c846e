"""Operators on ordered events, timelines, intervals, references and ledgers."""
