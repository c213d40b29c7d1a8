"""Operators of a training-data pipeline. Nothing else in the library imports
this subpackage; its queries and oracle SQL are in :mod:`lexframe.llm.queries`."""
