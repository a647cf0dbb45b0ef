"""Spark-native clinical concept extraction and text data processing."""

from notelode.lexicon import DEFAULT, Lexicon
from notelode.plans.pipeline import concept_rows, concepts_json, extract_concepts

__all__ = ["DEFAULT", "Lexicon", "concept_rows", "concepts_json", "extract_concepts"]
