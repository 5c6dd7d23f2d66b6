"""Query of URL filters."""

from skyloom.llm.registry import query, table
from skyloom.llm.url_filter import judged

#: Fixed values of the query: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

OP5 = r"""
with urls as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
  from pages
), rules(h, p, v) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best as (
  select host, path, arg_max(h || p, length(h) + length(p)) as rule, arg_max(v, length(h) + length(p)) as verdict
  from (select distinct host, path from urls) u join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  group by host, path
)
select page_id, u.host, u.path, rule, coalesce(verdict, 'allow') as verdict
from urls u left join best b on u.host = b.host and u.path = b.path
"""


@query(OP5)
def op5_url_filter(spark, sf_dir):
    """Verdict and rule of every page."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judged(table(spark, sf_dir, "pages"), rules)
