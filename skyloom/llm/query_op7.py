"""Query of tool-call linking.

The conversations hold no tool calls, so calls are derived from their turns: a
user's turn is a call, named by its turn, that waits for the user's turn before
it, and an assistant's turn is the result for the turn before it.
"""

from pyspark.sql import functions as F

from skyloom.llm.registry import query, table
from skyloom.llm.tool_calls import linked

#: Tools by the number of the turn, and their schemas; one has an argument that no call gives.
TOOLS = ["lookup", "translate", "summarise"]
SCHEMAS = {
    "lookup": {"text": ("string", True), "turn": ("integer", True)},
    "translate": {"text": ("string", True), "turn": ("integer", True), "target": ("string", False)},
    "summarise": {"text": ("string", True), "turn": ("integer", True), "words": ("integer", True)},
}

OP7 = """
with recursive calls as (
  select conv_id, turn, 'c' || turn as call_id, text,
    case turn % 3 when 0 then 'lookup' when 1 then 'translate' else 'summarise' end as name
  from conversations where role = 'user'
), results as (
  select conv_id, turn, 'c' || (turn - 1) as call_id, text as content from conversations where role = 'assistant'
), steps as (
  select conv_id, turn, 0 as level from calls c
  where not exists (select 1 from calls p where p.conv_id = c.conv_id and p.turn = c.turn - 2)
  union all
  select c.conv_id, c.turn, s.level + 1 from steps s join calls c on c.conv_id = s.conv_id and c.turn = s.turn + 2
), held as (
  select c.conv_id, c.turn, c.call_id, c.name, s.level, r.turn as result_turn,
    case when r.turn is null then 'open' else 'linked' end as status,
    case when c.turn >= 2 and s.level = 0 then 'unknown dependency' when c.text is null then 'text: no string'
      when c.name = 'summarise' then 'words: missing' end as problem,
    json_object('arguments', json_object('text', c.text, 'turn', c.turn), 'call', c.call_id, 'conversation', c.conv_id,
      'level', s.level, 'name', c.name, 'result', r.content, 'turn', c.turn)::varchar as line
  from calls c join steps s on c.conv_id = s.conv_id and c.turn = s.turn
  left join results r on c.conv_id = r.conv_id and c.call_id = r.call_id
), lone as (
  select r.conv_id, r.turn, r.call_id, null as name, null as level, r.turn as result_turn, 'orphan' as status, null as problem,
    json_object('call', r.call_id, 'conversation', r.conv_id, 'result', r.content, 'turn', r.turn)::varchar as line
  from results r where not exists (select 1 from calls c where c.conv_id = r.conv_id and c.call_id = r.call_id)
)
select conv_id, turn, call_id, name, level, status, problem, line from held
union all select conv_id, turn, call_id, name, level, status, problem, line from lone
"""


@query(OP7)
def op7_tool_calls(spark, sf_dir):
    """Every call and unmet result of all conversations as canonical JSON."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    name = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    arguments = F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"})
    calls = turns.filter("role = 'user'").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), F.element_at(F.array(*map(F.lit, TOOLS)), (F.col("turn") % 3 + 1).cast("int")).alias("name"),
        arguments.alias("arguments"), F.when(F.col("turn") >= 2, name(F.col("turn") - 2)).alias("after"),
    )
    results = turns.filter("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return linked(calls, results, SCHEMAS)
