"""Query of ranked lexical search."""

from skyloom.llm.ranked_search import ranked
from skyloom.llm.registry import query, table

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""
with listed as (
  select row_number() over () as row_no, doc_id, {_TERMS} as terms from documents where text is not null
), held as (
  select row_no, doc_id, terms, len(terms)::bigint as n from listed where len(terms) > 0
), totals as (
  select count(*)::bigint as big_n, sum(n)::hugeint as big_l from held
), tf as (
  select row_no, term, count(*)::bigint as tf from (select row_no, unnest(terms) as term from held) group by row_no, term
), weight as (
  select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select term, count(*)::bigint as df from tf group by term), totals
), items as (
  select row_number() over () as item_row, item_id, {_TERMS} as terms from benchmark where text is not null
), asked as (
  select item_row, item_id, term, count(*)::bigint as times from (select item_row, item_id, unnest(terms) as term from items) group by item_row, item_id, term
), scored as (
  select a.item_row, a.item_id, h.row_no, h.doc_id,
    sum(a.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 75 + ((75 * h.n::hugeint * big_n) // big_l)::bigint))))::bigint as score
  from asked a join weight w using (term) join tf t using (term) join held h using (row_no), totals
  group by a.item_row, a.item_id, h.row_no, h.doc_id
), placed as (
  select *, row_number() over (partition by item_row order by score desc, doc_id nulls last) as rank from scored where score > 0
)
select item_id, rank::integer as rank, doc_id, score from placed where rank <= 10
"""


@query(OP13)
def op13_ranked_search(spark, sf_dir):
    """The ten best documents for every benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
