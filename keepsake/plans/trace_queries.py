"""Queries over agent traces. Events are JSON texts made of the columns of the event table by an expression that both
engines know; the SQL says what each habit of reporting comes to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.operators import prompts, usage
from keepsake.plans.registry import big, register
from keepsake.runtime import table


def _events(spark: SparkSession, d: str, text: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", F.expr(text).alias("event"))


_N = "cast(event_id % 1000 as {s})"


def _s(x: str) -> str:
    """A number of the table as text in both engines."""
    return f"cast({x} as varchar(20))"


_I, _O, _C = "event_id % 1000", "event_id % 77", "event_id % 13"
# Eight habits of reporting tokens.
_USAGE = f"""case event_id % 8
  when 0 then '{{"input_tokens": ' || {_s(_I)} || ', "output_tokens": ' || {_s(_O)} || ', "cache_read_input_tokens": ' || {_s(_C)} || ', "cache_creation": {{"ephemeral_5m_input_tokens": 3, "ephemeral_1h_input_tokens": 4}}}}'
  when 1 then '{{"prompt_tokens": "' || {_s(_I)} || '", "completion_tokens": ' || {_s(_O)} || ', "total_tokens": ' || {_s(f'{_I} + {_O} + 5')} || '}}'
  when 2 then '{{"inputTokens": ' || {_s(_I)} || ', "outputTokens": ' || {_s(_O)} || ', "cachedInputTokens": ' || {_s(_C)} || ', "totalTokens": 5000}}'
  when 3 then '{{"total": ' || {_s(f'{_I} + {_O}')} || ', "input": ' || {_s(_I)} || ', "output": ' || {_s(_O)} || ', "reasoning": 2, "cache": {{"read": ' || {_s(_C)} || ', "write": 1}}}}'
  when 4 then '{{"input_tokens": ' || {_s(_I)} || '.75, "output_tokens": true}}'
  when 5 then '{{"output_tokens": ' || {_s(_O)} || '}}'
  when 6 then '{{"words": 3, "total": "x", "input": null, "output": "7y"}}'
  else 'no json {{' end"""

_COUNTED = f"""with e as (select event_id, user_id, event_id % 8 as h, {_I} as i, {_O} as o, {_C} as c from events),
u as (select event_id, user_id, h,
  case h when 0 then i + 7 + c when 1 then i when 2 then greatest(0, i - c) + c when 3 then i + 1 + c when 4 then i end as input_tokens,
  case h when 0 then i when 1 then i when 2 then greatest(0, i - c) when 3 then i when 4 then i end as uncached_tokens,
  case h when 0 then 7 when 3 then 1 end as cache_write_tokens, case when h in (0, 2, 3) then c end as cache_read_tokens,
  case when h in (0, 1, 5) then o when h = 2 then nullif(o, 0) when h = 3 then o + 2 end as output_tokens,
  case h when 0 then i + 7 + c + o when 1 then i + o + 5 when 2 then 5000 when 3 then i + o end as total_tokens from e)
"""


@register(_COUNTED + """select event_id, input_tokens::bigint as input_tokens, uncached_tokens::bigint as uncached_tokens, cache_write_tokens::bigint as cache_write_tokens, cache_read_tokens::bigint as cache_read_tokens,
  output_tokens::bigint as output_tokens, total_tokens::bigint as total_tokens, h in (0, 1, 2, 3, 4, 5) as reports from u where h <> 7""")
def usage_habits(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of usage objects by the names and nestings of different tools."""
    v = F.try_parse_json("event")
    rows = _events(spark, d, _USAGE).select("event_id", v.alias("v")).where("v is not null")
    return rows.select("event_id", usage.usage_fields(F.col("v")).alias("u"), F.coalesce(usage.has_usage(F.col("v")), F.lit(False)).alias("reports")).select("event_id", "u.*", "reports")


_NESTED = f"""case when event_id % 8 = 7 then '{{{{' else '{{"type": "step", ' || case event_id % 3 when 0 then '"message": {{"id": "m' || {_s('event_id // 10')} || '"}}, ' when 1 then '"request_id": " r' || {_s('event_id // 10')} || ' ", ' else '' end
  || '"data": [{{"usage": ' || ({_USAGE}) || '}}, 1], "cost": ' || case when event_id % 2 = 0 then '"0.5"' else 'true' end || ', "response": {{"model": "gpt-' || {_s('event_id % 4')} || '"}}}}' end"""
_NESTED_SPARK = _NESTED.replace("event_id // 10", "event_id div 10")


@register(_COUNTED + """select u.event_id, u.user_id, case event_id % 3 when 0 then 'm' || (event_id // 10) when 1 then 'r' || (event_id // 10) end as group_id, input_tokens::bigint as input_tokens, output_tokens::bigint as output_tokens,
  total_tokens::bigint as total_tokens from u where h in (0, 1, 2, 3, 4, 5)""")
def usage_records(spark: SparkSession, d: str) -> DataFrame:
    """Usage objects found anywhere in events, with the events' ids."""
    out = usage.usage_records(_events(spark, d, _NESTED_SPARK), ["user_id"], "event_id", "event")
    return out.select(F.col("seq").alias("event_id"), "user_id", "group_id", "input_tokens", "output_tokens", "total_tokens")


@register("""select event_id, case when event_id % 2 = 0 then 0.5::double end as cost, case event_id % 3 when 0 then 'm' || (event_id // 10) when 1 then 'r' || (event_id // 10) end as id, 'gpt-' || (event_id % 4) as model, 'acme/m' || event_id as meta_model, 'far' as far_model
  from events where event_id % 8 < 6""")
def event_ids_costs_models(spark: SparkSession, d: str) -> DataFrame:
    """Correlation ids, costs and model names at the places where tools put them."""
    rows = _events(spark, d, _NESTED_SPARK).where("event_id % 8 < 6").select("event_id", F.try_parse_json("event").alias("v"))
    meta = F.try_parse_json(F.concat(F.lit('{"meta": {"agentMeta": {"provider": "acme", "model": "m'), F.col("event_id").cast("string"), F.lit('"}}}')))
    far = F.try_parse_json(F.lit('{"result": {"message": {"modelId": "far"}}}'))
    v = F.col("v")
    return rows.select("event_id", usage.cost(v).alias("cost"), usage.correlation_id(v).alias("id"), usage.model_name(v).alias("model"), usage.model_name(meta).alias("meta_model"), usage.model_name(far).alias("far_model"))


_FINAL = f"""case when event_id % 4 = 0 then '{{"type": "result", "subtype": "' || case when event_id % 8 = 0 then 'success' else 'error' end || '", "session_id": "s' || {_s('user_id')} || '", "usage": {{"input_tokens": ' || {_s(_I)} || ', "output_tokens": ' || {_s(_O)} || '}}, "total_cost_usd": 0.25}}'
  else '{{"id": "e' || {_s('event_id')} || '", "usage": {{"input_tokens": 1, "output_tokens": ' || {_s(_O)} || '}}}}' end"""


@register(f"""with e as (select event_id, user_id, {_I} as i, {_O} as o from events),
l as (select user_id, max(event_id) as event_id from e where event_id % 8 = 0 group by user_id),
f as (select e.user_id, e.event_id, 's' || e.user_id as group_id, i as input_tokens, o as output_tokens, 0.25::double as cost_usd from e join l using (user_id, event_id)),
r as (select e.user_id, e.event_id, case when event_id % 4 <> 0 then 'e' || event_id end as group_id, case when event_id % 4 = 0 then i else 1 end as input_tokens, o as output_tokens, null as cost_usd from e anti join l using (user_id))
select user_id, event_id, group_id, input_tokens::bigint as input_tokens, output_tokens::bigint as output_tokens, (input_tokens + output_tokens)::bigint as total_tokens, cost_usd from (from f union all from r)""")
def final_usage(spark: SparkSession, d: str) -> DataFrame:
    """The last successful result of a run, else all its events."""
    out = usage.final_usage(_events(spark, d, _FINAL), ["user_id"], "event_id", "event")
    return out.select("user_id", F.col("seq").alias("event_id"), "group_id", "input_tokens", "output_tokens", "total_tokens", "cost_usd")


_ENDS = f"""case when event_id % 3 = 0 then '{{"type": "message_end", "id": "e' || {_s('event_id')} || '", "message": {{"role": "' || case when event_id % 2 = 0 then 'assistant' else 'user' end || '", ' || case when event_id % 4 = 0 then '"responseId": "r' || {_s('event_id')} || '", ' else '' end
  || '"usage": {{"input": ' || {_s(_I)} || ', "output": ' || {_s(_O)} || ', "cacheRead": ' || {_s(_C)} || ', "cacheWrite": 2, "totalTokens": 9000, "cost": {{"total": 0.125}}}}}}}}' else '{{"type": "other"}}' end"""


@register(f"""select user_id, event_id, case when event_id % 4 = 0 then 'r' else 'e' end || event_id as group_id, ({_I} + {_C} + 2)::bigint as input_tokens, ({_I})::bigint as uncached_tokens, 2::bigint as cache_write_tokens, ({_C})::bigint as cache_read_tokens,
  ({_O})::bigint as output_tokens, 9000::bigint as total_tokens, 0.125::double as cost_usd from events where event_id % 6 = 0""")
def message_usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage of each finished assistant message."""
    out = usage.message_usage(_events(spark, d, _ENDS), ["user_id"], "event_id", "event")
    return out.select("user_id", F.col("seq").alias("event_id"), "group_id", "input_tokens", "uncached_tokens", "cache_write_tokens", "cache_read_tokens", "output_tokens", "total_tokens", "cost_usd")


# One run per thousand users' ids; the strongest kind of answer depends on the run.
_TRACE = f"""case
  when user_id % 5 = 0 and event_id % 3 = 0 then '{{"message": {{"content": [{{"type": "text", "text": "no"}}, {{"type": "tool_use", "input": {{"answer": "t' || {_s('event_id')} || '"}}}}]}}}}'
  when user_id % 5 in (0, 1) and event_id % 3 = 1 then '{{"type": "result", "subtype": "success", "result": "r' || {_s('event_id')} || '"}}'
  when user_id % 5 in (0, 1, 2) and event_id % 3 = 2 then '{{"part": {{"state": {{"input": {{"filePath": "/x/output/answer.json", "content": "f' || {_s('event_id')} || '"}}}}}}}}'
  when user_id % 5 = 4 then 'not json'
  else '{{"type": "text", "part": {{"text": "a' || {_s('event_id')} || '"}}}}' end"""


@register("""with e as (select user_id, event_id, case when user_id % 5 = 0 and event_id % 3 = 0 then 4 when user_id % 5 in (0, 1) and event_id % 3 = 1 then 3 when user_id % 5 in (0, 1, 2) and event_id % 3 = 2 then 2 when user_id % 5 = 4 then 0 else 1 end as p from events),
m as (select user_id, max((p, event_id)) as m from e where p > 0 group by user_id)
select user_id, case m[1] when 4 then '{"answer":"t' || m[2] || '"}' when 3 then 'r' || m[2] when 2 then 'f' || m[2] else 'a' || m[2] end as answer, case m[1] when 4 then 'structured' when 3 then 'result' when 2 then 'file' else 'text' end as source from m""")
def final_answers(spark: SparkSession, d: str) -> DataFrame:
    """A run's answer: structured tool input, result, written file or last text."""
    return usage.final_answers(_events(spark, d, _TRACE), ["user_id"], "event_id", "event")


_TALK = f"""case event_id % 7
  when 0 then '{{"role": "assistant", "content": "c' || {_s('event_id')} || '"}}' when 1 then '{{"message": {{"role": "assistant", "content": [{{"text": "one"}}, {{"text": " "}}, "two"]}}}}'
  when 2 then '{{"data": {{"message": {{"role": "assistant", "text": "deep"}}}}}}' when 3 then '{{"role": "user", "content": "q", "result": "res"}}' when 4 then '{{"output": [{{"text": "out"}}]}}'
  when 5 then '{{"type": "text", "part": {{"text": " part "}}}}' else '{{"role": "user", "content": "q"}}' end"""


@register("select event_id, case event_id % 7 when 0 then 'c' || event_id when 1 then 'one' || chr(10) || 'two' when 2 then 'deep' when 3 then 'res' when 4 then 'out' when 5 then 'part' end as said from events")
def assistant_texts(spark: SparkSession, d: str) -> DataFrame:
    """What an assistant says, in messages, blocks and final fields."""
    return _events(spark, d, _TALK).select("event_id", usage.assistant_text(F.try_parse_json("event")).alias("said"))


@register("""select event_id, case event_id % 5 when 0 then event_id when 1 then 7 when 2 then 3 end::bigint as whole, case event_id % 5 when 0 then event_id when 1 then 7 when 2 then 3.9 when 3 then 2.5 end::double as number, case when event_id % 5 = 1 then '7' when event_id % 5 = 3 then '2.5' end as text from events""")
def numbers_in_json(spark: SparkSession, d: str) -> DataFrame:
    """Whole numbers, numbers and texts at a path, of numbers, texts and booleans."""
    text = """case event_id % 5 when 0 then '{"x": ' || cast(event_id as varchar(20)) || '}' when 1 then '{"x": " 7 "}' when 2 then '{"x": 3.9}' when 3 then '{"x": "2.5"}' else '{"x": true}' end"""
    rows = _events(spark, d, text).select("event_id", F.try_parse_json("event").alias("v"))
    return rows.select("event_id", usage.int_at(F.col("v"), "x").alias("whole"), usage.float_at(F.col("v"), "x").alias("number"), usage.text_at(F.col("v"), "x").alias("text"))


@register("""with r as (select event_id % 1000 as p, case when event_id % 3 = 0 then null else event_id % 77 end as c, case when event_id % 2 = 0 then null else event_id % 500 end as t from events)
select count(*) as answers, sum(p)::bigint as prompt_sum, round(avg(p), 4) as prompt_avg, sum(c)::bigint as completion_sum, round(avg(c), 4) as completion_avg, sum(coalesce(t, p + c))::bigint as total_sum, round(avg(coalesce(t, p + c)), 4) as total_avg from r""")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    """Token statistics of a run's answers, totals filled from their parts."""
    r = table(spark, d, "events").selectExpr("event_id % 1000 as prompt_tokens", "case when event_id % 3 = 0 then null else event_id % 77 end as completion_tokens", "case when event_id % 2 = 0 then null else event_id % 500 end as total_tokens")
    out = prompts.token_stats(r)
    return out.select(*[F.round(c, 4).alias(c) if c.endswith("avg") else big(F.col(c)).alias(c) for c in out.columns])


_HITS = """case event_id % 5 when 0 then '[{"memory": "m' || cast(event_id as varchar(20)) || '", "score": 0.5, "metadata": {"item_id": "i' || cast(event_id as varchar(20)) || '"}}, {"memory": "", "text": ""}]'
  when 1 then '{"results": [{"text": "[b' || cast(event_id as varchar(20)) || '] t"}, {"memory": "x", "item_id": "y"}]}' when 2 then '{"results": [], "data": [{"memory": "d"}]}' when 3 then '{"other": 1}' else '"text"' end"""


@register("""with e as (select event_id, event_id % 5 as k from events)
select event_id, 1::bigint as place, case k when 0 then 'm' || event_id when 1 then '[b' || event_id || '] t' else 'd' end as text, case k when 0 then 'i' || event_id when 1 then 'b' || event_id end as item_id, case k when 0 then 0.5 else 0.0 end::double as score from e where k < 3
union all select event_id, 2, 'x', 'y', 0.0 from e where k = 1""")
def search_hits(spark: SparkSession, d: str) -> DataFrame:
    """Replies of memory searches of any shape as texts, items and scores."""
    rows = _events(spark, d, _HITS).select("event_id", F.posexplode(usage.search_hits(F.try_parse_json("event"))).alias("p", "h"))
    return rows.select("event_id", big(F.col("p") + 1).alias("place"), "h.*")
