"""Registered queries of the evaluation engine, by operator family."""
