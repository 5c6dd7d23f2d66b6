"""Query of language identification."""

from skyloom.llm.language_id import identified
from skyloom.llm.registry import query, table


@query()
def op8_language_id(spark, sf_dir):
    """Predicted language of every document."""
    return identified(table(spark, sf_dir, "documents"))
