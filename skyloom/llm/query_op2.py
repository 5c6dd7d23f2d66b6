"""Query of sentence pieces."""

from pyspark.sql import functions as F

from skyloom.llm.registry import query, table
from skyloom.llm.sentence_pieces import round_trip


def pieces_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query()
def op2_sentence_pieces(spark, sf_dir):
    """Ids of every document, decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = round_trip(docs, pieces_file())
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == text).alias("same"),
    )
