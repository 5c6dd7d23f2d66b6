"""Query of maintained token counts."""

from pyspark.sql import functions as F

from skyloom.llm.query_op1 import vocabulary
from skyloom.llm.registry import query, table
from skyloom.llm.rows import bounded
from skyloom.llm.token_counts import Rollup, deleted, inserted, revised, token_counts
from skyloom.session import materialise, new_table_path

VERSION = "byte_bpe_50k/1"
#: Documents of low quality are counted anew with each of these runs as one space.
SPACES = r"[\x20\x09-\x0D]+"


@query()
def op6_token_counts(spark, sf_dir):
    """Totals after all documents came, low-quality ones were tidied and toxic ones withdrawn."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    path = vocabulary()
    counts = materialise(token_counts(docs, path, VERSION), "token-counts")
    toxic = bounded(materialise(labels.filter("toxic = 1").select("doc_id").distinct(), "toxic"))
    poor = bounded(materialise(labels.filter("quality = 0 and toxic = 0").select("doc_id").distinct(), "poor"))
    rollup = Rollup(spark, new_table_path(spark, "rollup"))
    rollup.commit("load", inserted(counts))
    tidy = token_counts(docs.join(poor, "doc_id", "left_semi").withColumn("text", F.regexp_replace("text", SPACES, " ")), path, VERSION)
    rollup.fold()
    rollup.commit("tidy", revised(counts.join(poor, "doc_id", "left_semi"), tidy))
    for _ in range(2):  # a commit that is retried
        rollup.commit("withdraw", deleted(counts.join(toxic, "doc_id", "left_semi")))
    return rollup.totals()
