"""Query of main-text extraction."""

from skyloom.llm.markup import BLOCK
from skyloom.llm.page_template import main_texts
from skyloom.llm.registry import query, table

_DECODED = "x"
for _name, _char in (("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _DECODED = f"replace({_DECODED}, '{_name}', '{_char}')"

# for pages whose main text is one article element without surroundings inside
OP11 = rf"""
with articles as (
  select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's'), '<br>', ' ', 'g') as a from pages
), blocks as (
  select page_id, url, list_transform(string_split_regex(a, '</?({"|".join(sorted(BLOCK))})>'), lambda b: regexp_replace(b, '<[^>]*>', '', 'g')) as b from articles
), decoded as (
  select page_id, url, list_transform(b, lambda x: trim(regexp_replace({_DECODED}, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) as b from blocks
), joined as (
  select page_id, url, coalesce(array_to_string(list_filter(b, lambda x: x <> ''), chr(10)), '') as text from decoded
)
select page_id, url, text, length(text) as n_chars from joined
"""


@query(OP11)
def op11_html_extraction(spark, sf_dir):
    """The main text of every page."""
    return main_texts(table(spark, sf_dir, "pages"))
