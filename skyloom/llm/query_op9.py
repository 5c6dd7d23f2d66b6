"""Query of exact top-k search."""

from pyspark.sql import functions as F

from skyloom.llm.registry import query, table
from skyloom.llm.topk_search import top_k

OP9 = """
with wide as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where vec_id is not null),
usable as (
  select vec_id, list_transform(e, lambda x: floor(1024 * x)::bigint) as v from wide
  where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(list_transform(q.v, lambda x: x::double), list_transform(c.v, lambda x: x::double))::bigint as score
  from usable q join usable c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 10
"""


@query(OP9)
def op9_topk_search(spark, sf_dir):
    """The ten best other vectors for every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
