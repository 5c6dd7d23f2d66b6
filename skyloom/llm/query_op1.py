"""Query of packing."""

from skyloom.llm.packing import packed_documents
from skyloom.llm.registry import query, table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op1_best_fit_packing(spark, sf_dir):
    """All documents in sequences of at most 1024 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"), vocabulary())
