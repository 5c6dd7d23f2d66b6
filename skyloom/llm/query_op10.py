"""Query of substring deduplication."""

from skyloom.llm.registry import query, table
from skyloom.llm.substring_dedup import removed_words


@query()
def op10_substring_dedup(spark, sf_dir):
    """Words of all documents that repeat in windows of 50 from a smaller doc_id."""
    return removed_words(table(spark, sf_dir, "documents"))
