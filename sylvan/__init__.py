"""Sylvan: structure-aware document retrieval and text analytics on Spark DataFrames."""

from sylvan.config import Config
from sylvan.operators.index import Index
from sylvan.operators.search import Corpus, Result, batch_search, document_scores, ranked_ids, search, search_documents, search_many, search_nodes
from sylvan.operators.tree import build, toc
from sylvan.plans.query import QueryPlan, build_expression, query_plan
from sylvan.sources.parsers import Registry
from sylvan.streaming.watch import sync, watch

__version__ = "0.2.0"
__all__ = [
    "Config", "Corpus", "Index", "QueryPlan", "Registry", "Result", "batch_search", "build", "build_expression", "document_scores", "query_plan",
    "ranked_ids", "search", "search_documents", "search_many", "search_nodes", "sync", "toc", "watch",
]
