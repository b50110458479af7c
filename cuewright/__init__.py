"""Corpus-scale cleaning of subtitle cues and other line-structured text on Spark."""

__version__ = "0.1.0"
