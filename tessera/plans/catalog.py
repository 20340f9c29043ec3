"""All registered queries; importing this module fills the registry."""

from tessera.plans import q_cls, q_corpus, q_encode, q_losses, q_retrieval, q_runs, q_streams, q_tagging  # noqa: F401
from tessera.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
