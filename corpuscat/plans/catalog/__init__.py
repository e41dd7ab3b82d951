"""The registered queries: each a Spark function and, where SQL can say it, an oracle."""

from corpuscat.plans.catalog import basics, categories, enrichment, models, steps, stores, tokens
from corpuscat.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "basics", "categories", "enrichment", "models", "steps", "stores", "tokens"]
