"""Query of near-duplicate detection."""

from skyloom.llm.near_dedup import PERCENT, near_groups
from skyloom.llm.registry import query, table


@query()
def op4_near_dedup(spark, sf_dir):
    """Components of documents linked by a Jaccard similarity of 0.85 or more."""
    return near_groups(table(spark, sf_dir, "documents"), PERCENT).select("doc_id", "n_shingles", "component_id", "kept")
