"""Spark jobs for event-annotation data: corpora, predictions, review and insights."""

from spanloom.ontology import Ontology, starter_ontology

__all__ = ["Ontology", "starter_ontology"]
