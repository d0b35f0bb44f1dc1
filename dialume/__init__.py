"""Transcript and speaker-turn analytics on Spark."""
