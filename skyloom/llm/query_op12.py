"""Query of the Merkle manifest."""

import string

from pyspark.sql import functions as F

from skyloom.llm.merkle import Manifest
from skyloom.llm.registry import query, table


def _field(name: str) -> str:
    value = f"cast({name} as varchar)"
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
# CRC-32 bit by bit: a byte is mixed in, and eight -1 each shift once
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
  string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, e: case when e >= 0 then xor(a, e) else xor(a >> 1, (a & 1) * 3988292384) end))"""

OP12 = f"""
with recursive leaves as (
  select doc_id, source, {_leaf('text')} as leaf, case when {_CRC} % 5 = 0 then {_leaf(_LOWER)} else {_leaf('text')} end as claim from documents
), placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by source) as n from leaves
), nodes as (
  select source, 0 as level, place as i, n, leaf as h from placed
  union all
  select source, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' order by i)) from nodes where n > 1 group by source, level, i // 16, n
), subroots as (
  select source, level, h, row_number() over (order by source nulls first) - 1 as place, count(*) over () as n from nodes where n = 1
), tops as (
  select 0 as level, place as i, n, h from subroots
  union all
  select level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' order by i)) from tops where n > 1 group by level, i // 16, n
), every as (
  select source, level, i, n, h, false as top from nodes where n > 1
  union all
  select null, level, i, n, h, true from tops where n > 1
), sides as (
  select a.source, a.level, a.i, a.top, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as lefts,
    coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as rights
  from every a join every b on a.source is not distinct from b.source and a.level = b.level and a.top = b.top and a.i // 16 = b.i // 16
  group by a.source, a.level, a.i, a.top
), lower_ as (
  select doc_id, source, place, leaf, claim as h, '' as proof, 0 as level, place as i from placed
  union all
  select f.doc_id, f.source, f.place, f.leaf, sha256(s.lefts || f.h || s.rights), f.proof || s.lefts || s.rights, f.level + 1, f.i // 16
  from lower_ f join sides s on not s.top and f.source is not distinct from s.source and f.level = s.level and f.i = s.i
), upper_ as (
  select l.doc_id, l.leaf, l.h, l.proof, 0 as level, s.place as i, s.h as subroot
  from lower_ l join subroots s on l.source is not distinct from s.source and l.level = s.level
  union all
  select f.doc_id, f.leaf, sha256(s.lefts || f.h || s.rights), f.proof || s.lefts || s.rights, f.level + 1, f.i // 16, f.subroot
  from upper_ f join sides s on s.top and f.level = s.level and f.i = s.i
)
select doc_id, leaf, subroot, r.h as root, sha256(proof) as proof_sha256, u.h as folded_root, u.h = r.h as verified
from upper_ u join (select h, level from tops where n = 1) r on u.level = r.level
"""


@query(OP12)
def op12_merkle_manifest(spark, sf_dir):
    """Every document's leaf, proof digest and check, a fifth of the rows being checked with an altered text."""
    altered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    docs = table(spark, sf_dir, "documents")
    return Manifest(docs, F.when(altered, lowered).otherwise(F.col("text"))).checked()
