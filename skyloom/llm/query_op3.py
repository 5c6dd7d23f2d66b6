"""Query of exact deduplication."""

from skyloom.llm.exact_dedup import exact_groups
from skyloom.llm.registry import query, table

OP3 = r"""
with texts as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
), kept as (
  select norm, min(doc_id) as keep_id, count(*) as group_size from texts group by norm
)
select t.doc_id, k.keep_id, k.group_size, t.doc_id = k.keep_id as kept, sha256(t.norm) as text_sha256
from texts t join kept k on t.norm = k.norm
"""


@query(OP3)
def op3_exact_dedup(spark, sf_dir):
    """Groups of equal texts over all documents."""
    rows = exact_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
