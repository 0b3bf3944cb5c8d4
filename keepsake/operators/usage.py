"""Token and cost accounting over nested event logs, and answers out of them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.answers import let
from keepsake.operators.corpus import grouped_index

# The names under which tools report tokens, cost, ids and models.
TOKEN_KEYS = "input_tokens output_tokens total_tokens prompt_tokens completion_tokens inputTokens outputTokens totalTokens promptTokens completionTokens".split()
COST_KEYS = "cost_usd total_cost_usd cost total_cost usd price_usd".split()
ID_KEYS = "response_id request_id completion_id message_id messageID id".split()
ID_PARENTS = "response request message part data result output".split()
MODEL_KEYS = "model model_id modelId".split()
MODEL_PARENTS = "message response result data output".split()


def _at(v: Column, *path: str) -> tuple[Column, Column]:
    p = "$" + "".join(f"['{x}']" for x in path)
    return F.try_variant_get(v, p, "variant"), F.try_variant_get(v, p, "string")


def int_at(v: Column, *path: str) -> Column:
    """A whole number at a path: numbers cut to their integer part, digit strings; booleans, other texts and NaN are null."""
    raw, text = _at(v, *path)
    kind = F.schema_of_variant(raw)
    t = F.trim(text)
    number = F.when(kind == "STRING", F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))).otherwise(F.coalesce(t.try_cast("bigint"), t.try_cast("double").try_cast("bigint")))
    return F.when(kind != "BOOLEAN", number)


def float_at(v: Column, *path: str) -> Column:
    """A finite number at a path, from numbers and texts; booleans are null."""
    raw, text = _at(v, *path)
    x = F.trim(text).try_cast("double")
    return F.when((F.schema_of_variant(raw) != "BOOLEAN") & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def text_at(v: Column, *path: str) -> Column:
    """The trimmed text at a path if it is a string and not blank."""
    raw, text = _at(v, *path)
    t = F.trim(text)
    return F.when((F.schema_of_variant(raw) == "STRING") & (t != ""), t)


def has_usage(v: Column) -> Column:
    """The object has a token key, or total, input and output with a number among them."""
    some = F.coalesce(*[_at(v, k)[0] for k in TOKEN_KEYS]).isNotNull()
    bare = _at(v, "total")[0].isNotNull() & _at(v, "input")[0].isNotNull() & _at(v, "output")[0].isNotNull()
    return some | (bare & F.coalesce(int_at(v, "total"), int_at(v, "input"), int_at(v, "output")).isNotNull())


# The paths of all counts in a usage object.
USAGE_PATHS = [
    ("input_tokens",), ("output_tokens",), ("total_tokens",), ("prompt_tokens",), ("completion_tokens",), ("totalTokens",), ("input",), ("cache", "read"), ("output",), ("total",), ("reasoning",), ("cache_creation", "ephemeral_5m_input_tokens"), ("cache_creation", "ephemeral_1h_input_tokens"), ("cache_creation_input_tokens",), ("cacheCreationInputTokens",), ("cache_creation_tokens",), ("cache", "write"), ("cache_read_input_tokens",), ("cacheReadInputTokens",), ("cached_input_tokens",), ("cachedInputTokens",), ("inputTokens",), ("promptTokens",), ("outputTokens",), ("completionTokens",),
]


def usage_fields(v: Column) -> Column:
    """struct of token counts of a usage object, whichever of the four naming habits it has.

    Input is all that was read: uncached, written to and read from a cache. A
    cached subset of a grand total is taken out of the uncached part. Separate
    reasoning tokens count as output. Without an explicit total it is the sum.
    """
    found = F.struct(*[int_at(v, *p).alias("_".join(p)) for p in USAGE_PATHS])

    def fields(s: Column) -> Column:
        n = lambda k: s[k]
        either = lambda a, b: F.coalesce(F.when(n(a) != 0, n(a)), n(b))
        pair = lambda a, b: a.isNull() & b.isNull()
        i1, o1, t1 = n("input_tokens"), n("output_tokens"), n("total_tokens")
        i2, o2 = n("prompt_tokens"), n("completion_tokens")
        i3, o3 = either("inputTokens", "promptTokens"), either("outputTokens", "completionTokens")
        none1, none2 = pair(i1, o1), pair(i2, o2)
        tok_in = F.when(~none1, i1).when(~none2, i2).otherwise(i3)
        tok_out = F.when(~none1, o1).when(~none2, o2).otherwise(o3)
        total = F.coalesce(t1, F.when(none1 & none2, n("totalTokens")))
        bare = tok_in.isNull() & tok_out.isNull() & total.isNull()
        tok_in = F.when(bare, n("input") + F.coalesce(n("cache_read"), F.lit(0))).otherwise(tok_in)
        tok_out = F.when(bare, n("output")).otherwise(tok_out)
        total = F.coalesce(F.when(bare, n("total")).otherwise(total), tok_in + tok_out)
        tok_out = tok_out + F.coalesce(n("reasoning"), F.lit(0))
        nonzero = lambda c: F.when(c != 0, c)
        explicit = F.coalesce(nonzero(n("total_tokens")), nonzero(n("totalTokens")), n("total"))
        uncached = F.coalesce(n("input_tokens"), n("prompt_tokens"), i3, n("input"))
        short, long = n("cache_creation_ephemeral_5m_input_tokens"), n("cache_creation_ephemeral_1h_input_tokens")
        parts = nonzero(F.coalesce(short, F.lit(0)) + F.coalesce(long, F.lit(0)))
        write = F.coalesce(n("cache_creation_input_tokens"), n("cacheCreationInputTokens"), n("cache_creation_tokens"), parts, n("cache_write"))
        read = F.coalesce(n("cache_read_input_tokens"), n("cacheReadInputTokens"), n("cache_read"))
        subset = F.when(read.isNull(), F.coalesce(n("cached_input_tokens"), n("cachedInputTokens")))
        uncached = F.when(subset.isNotNull(), F.greatest(F.lit(0), uncached - subset)).otherwise(uncached)
        read = F.coalesce(read, subset)
        zero = lambda c: F.coalesce(c, F.lit(0))
        effective = F.when(F.coalesce(uncached, write, read).isNotNull(), zero(uncached) + zero(write) + zero(read))
        tok_in = F.coalesce(effective, tok_in)
        total = F.coalesce(explicit, tok_in + tok_out, total)
        return F.struct(
            tok_in.alias("input_tokens"), uncached.alias("uncached_tokens"), write.alias("cache_write_tokens"), read.alias("cache_read_tokens"), tok_out.alias("output_tokens"), total.alias("total_tokens")
        )

    return let(found, fields)


def cost(v: Column) -> Column:
    return F.coalesce(*[float_at(v, k) for k in COST_KEYS])


def correlation_id(v: Column) -> Column:
    """The first id of an event, at its top, then in its parents."""
    return let(v, lambda e: F.coalesce(*[text_at(e, k) for k in ID_KEYS], *[text_at(e, p, k) for p in ID_PARENTS for k in ID_KEYS]))


def model_name(v: Column) -> Column:
    """A model's name at the top, in agent meta with its provider, or up to two parents deep."""

    def name(e: Column) -> Column:
        provider, model = text_at(e, "meta", "agentMeta", "provider"), text_at(e, "meta", "agentMeta", "model")
        meta = F.when(model.isNotNull(), F.concat_ws("/", provider, model))
        near = [text_at(e, k) for k in MODEL_KEYS] + [text_at(e, p, k) for p in MODEL_PARENTS for k in MODEL_KEYS]
        far = [text_at(e, p, q, k) for p in MODEL_PARENTS for q in MODEL_PARENTS for k in MODEL_KEYS]
        return F.coalesce(meta, *near, *far)

    return let(v, name)


def usage_objects(text: str | None) -> list[str]:
    """Every object inside a JSON text that reports tokens, outer ones first, those within others too."""
    try:
        todo = [json.loads(text)] if text else []
    except (json.JSONDecodeError, RecursionError):
        return []
    out = []
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            number = lambda k: isinstance(x.get(k), (int, float)) and not isinstance(x.get(k), bool)
            if any(k in x for k in TOKEN_KEYS) or ({"total", "input", "output"} <= x.keys() and any(number(k) for k in ("total", "input", "output"))):
                out.append(json.dumps(x, ensure_ascii=False))
            todo += reversed(list(x.values()))
        elif isinstance(x, list):
            todo += reversed(x)
    return out


def usage_records(events: DataFrame, run: list[str], seq: str, event: str) -> DataFrame:
    """One row per usage object in JSON events: run columns, seq, group_id, token counts and cost.

    Unreadable events give none. The group is the event's correlation id.
    """

    @F.pandas_udf("array<string>")
    def objects(s: pd.Series) -> pd.Series:
        return s.map(usage_objects)

    rows = events.select(*run, F.col(seq).alias("seq"), F.try_parse_json(F.col(event)).alias("_e"), F.posexplode(objects(F.col(event))).alias("_n", "_o"))
    v = F.try_parse_json("_o")
    return rows.select(*run, "seq", F.col("_n").alias("part"), correlation_id(F.col("_e")).alias("group_id"), usage_fields(v).alias("_u"), cost(v).alias("cost_usd")).select(*run, "seq", "part", "group_id", "_u.*", "cost_usd")


def final_usage(events: DataFrame, run: list[str], seq: str, event: str) -> DataFrame:
    """One usage record per run: of its last successful result that reports tokens, grouped by its session.

    Cost is the event's, else that of its usage object. A run without such a
    result gives the records of all its events (``usage_records``).
    """
    v = F.try_parse_json(F.col(event))
    u = F.try_variant_get("v", "$.usage", "variant")
    rows = events.select(*run, F.col(seq).alias("seq"), v.alias("v")).where((text_at(F.col("v"), "type") == "result") & (text_at(F.col("v"), "subtype") == "success"))
    rows = rows.select(*run, "seq", text_at(F.col("v"), "session_id").alias("group_id"), usage_fields(u).alias("u"), F.coalesce(cost(F.col("v")), cost(u)).alias("cost_usd"), F.schema_of_variant(u).startswith("OBJECT").alias("is_object"))
    last = rows.where("is_object").groupBy(*run).agg(F.max_by(F.struct("seq", "group_id", "u", "cost_usd"), "seq").alias("m"))
    last = last.where("coalesce(m.u.input_tokens, m.u.output_tokens, m.u.total_tokens) is not null").select(*run, "m.seq", F.lit(0).alias("part"), "m.group_id", "m.u.*", "m.cost_usd")
    rest = events.join(last.select(*[F.col(c).alias(f"_{c}") for c in run]), [events[c].eqNullSafe(F.col(f"_{c}")) for c in run], "left_anti")
    return last.unionByName(usage_records(rest, run, seq, event))


def message_usage(events: DataFrame, run: list[str], seq: str, event: str) -> DataFrame:
    """One usage record per finished assistant message that reports tokens, grouped by its response, message or event id."""
    v = F.col("v")
    m, u = F.try_variant_get("v", "$.message", "variant"), F.try_variant_get("v", "$.message.usage", "variant")
    rows = events.select(*run, F.col(seq).alias("seq"), F.try_parse_json(F.col(event)).alias("v"))
    rows = rows.where((text_at(v, "type") == "message_end") & (text_at(v, "message", "role") == "assistant"))
    group = F.coalesce(text_at(v, "message", "responseId"), correlation_id(m), correlation_id(v))
    return rows.select(*run, "seq", F.lit(0).alias("part"), group.alias("group_id"), message_fields(u).alias("u"), F.coalesce(float_at(u, "cost", "total"), cost(u)).alias("cost_usd")).where(
        "coalesce(u.input_tokens, u.output_tokens, u.total_tokens) is not null"
    ).select(*run, "seq", "part", "group_id", "u.*", "cost_usd")


def message_fields(u: Column) -> Column:
    """As ``usage_fields``, of a message's usage: input, output, cacheRead, cacheWrite and totalTokens, or total where that is 0 or absent."""
    found = F.struct(*[int_at(u, k).alias(k) for k in ("input", "output", "cacheRead", "cacheWrite", "totalTokens", "total")])

    def fields(s: Column) -> Column:
        zero = lambda k: F.coalesce(s[k], F.lit(0))
        tok_in = F.when(F.coalesce(s["input"], s["cacheRead"], s["cacheWrite"]).isNotNull(), zero("input") + zero("cacheRead") + zero("cacheWrite"))
        total = F.coalesce(F.when(s["totalTokens"] != 0, s["totalTokens"]), s["total"], tok_in + s["output"])
        names = ("input_tokens", "uncached_tokens", "cache_write_tokens", "cache_read_tokens", "output_tokens", "total_tokens")
        return F.struct(*[c.alias(n) for n, c in zip(names, (tok_in, s["input"], s["cacheWrite"], s["cacheRead"], s["output"], total))])

    return let(found, fields)


def search_hits(reply: Column) -> Column:
    """array<struct(text, item_id, score)> of a memory search's reply: a list, or an object with one under results or data.

    The text is memory, else text; hits without text are left out. The id is the
    metadata's, the hit's, or the first in square brackets in the text. A missing
    score is 0. Several hits may name one item.
    """
    from keepsake.functions.formats import bracket_id

    at = lambda path, kind: F.try_variant_get(reply, path, kind)
    lists = [F.when(F.size(at(p, "array<variant>")) > 0, at(p, "array<variant>")) for p in ("$", "$.results", "$.data")]
    hits = F.coalesce(*lists, F.array().cast("array<variant>"))
    text = lambda h, *ks: F.coalesce(*[F.when(F.try_variant_get(h, k, "string") != "", F.try_variant_get(h, k, "string")) for k in ks])

    def hit(h: Column) -> Column:
        t = text(h, "$.memory", "$.text")
        return F.struct(t.alias("text"), F.coalesce(text(h, "$.metadata.item_id", "$.item_id"), bracket_id(t)).alias("item_id"), F.coalesce(F.try_variant_get(h, "$.score", "double"), F.lit(0.0)).alias("score"))

    return F.filter(F.transform(hits, hit), lambda h: h["text"].isNotNull())


COUNTS = ("input_tokens", "uncached_tokens", "cache_write_tokens", "cache_read_tokens", "output_tokens", "total_tokens", "cost_usd")


def total_usage(records: DataFrame, run: list[str], order: list[str]) -> DataFrame:
    """One row per run: sums over the records that count, null where no record has a value, and their number.

    Of each group the record with the largest total counts, of equal ones the
    later. Ungrouped records count once per distinct (input, output, total,
    cost), unless at least two totals never fall in ``order`` and sum to more
    than 1.2 times the largest: then they are running totals, and only the
    first of the largest counts. Groups are aggregated before the shuffle; for
    the fall test a run's ungrouped records are numbered without gathering them
    in one task (``grouped_index``), and each total is joined to the one before.
    Order records fully.
    """
    have = [c for c in COUNTS if c in records.columns]
    score = F.coalesce("total_tokens", F.lit(0))
    # Columns the order shares with the counts are kept apart by their place in a struct.
    body = F.struct(*have).alias("r")
    grouped = records.where("group_id is not null").groupBy(*run, "group_id").agg(F.max(F.struct(score.alias("s"), F.struct(*order).alias("o"), body)).alias("m")).select(*run, "m.r")
    loose = records.where("group_id is null")
    told = loose.where("total_tokens is not null").select(*[F.col(c).alias(f"r{i}") for i, c in enumerate(run)], F.struct(*order).alias("o"), "total_tokens")
    keys = [f"r{i}" for i in range(len(run))]
    told = grouped_index(told, keys, ["o"], "place")
    later = told.select(*[F.col(k).alias(f"_{k}") for k in keys], (F.col("place") - 1).alias("_place"), F.col("total_tokens").alias("_next"))
    falls = told.join(later, [told["place"] == F.col("_place"), *[told[k].eqNullSafe(F.col(f"_{k}")) for k in keys]]).where("_next < total_tokens")
    falls = falls.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    shape = loose.groupBy(*run).agg(
        F.count("total_tokens").alias("n"), F.sum("total_tokens").alias("sum"), F.max("total_tokens").alias("max"), F.min(F.struct((-score).alias("s"), F.struct(*order).alias("o"), body)).alias("best")
    )
    shape = shape.where((F.col("n") >= 2) & (F.col("sum") > F.col("max") * 1.2)).join(falls, [shape[c].eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate(run)], "left_anti").withColumn("running", F.lit(True))
    best = shape.where("running").select(*run, F.col("best.r").alias("r"))
    single = loose.join(shape.where("running").select(*[F.col(c).alias(f"_{c}") for c in run]), [loose[c].eqNullSafe(F.col(f"_{c}")) for c in run], "left_anti")
    key = [c for c in ("input_tokens", "output_tokens", "total_tokens", "cost_usd") if c in have]
    distinct = single.groupBy(*run, *key).agg(F.min(F.struct(F.struct(*order).alias("o"), body)).alias("m")).select(*run, "m.r")
    chosen = grouped.unionByName(best).unionByName(distinct)
    out = chosen.groupBy(*run).agg(*[F.sum(f"r.{c}").alias(c) for c in have], F.count(F.lit(1)).alias("records_selected"))
    return out.withColumn("total_tokens", F.coalesce("total_tokens", F.col("input_tokens") + F.col("output_tokens")))


def block_text(v: Column, *path: str) -> Column:
    """The text at a path: a string, or the texts of its list of blocks, one per line; null where blank."""
    plain = text_at(v, *path)
    raw, _ = _at(v, *path)
    blocks = F.try_variant_get(raw, "$", "array<variant>")
    texts = F.filter(F.transform(blocks, lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string")))), lambda t: F.trim(t) != "")
    joined = F.trim(F.array_join(texts, "\n"))
    return F.coalesce(plain, F.when(joined != "", joined))


def assistant_text(v: Column) -> Column:
    """What an assistant says in an event: text parts, assistant messages at several depths, final fields."""
    said = lambda *p: F.when(text_at(v, *p, "role") == "assistant", F.coalesce(*[block_text(v, *p, k) for k in ("content", "text", "message")]))
    part = F.when(text_at(v, "type") == "text", text_at(v, "part", "text"))
    final = [x for k in ("final", "output", "result") for x in (said(k), block_text(v, k))]
    return F.coalesce(part, said(), said("message"), said("data"), said("data", "message"), *final)


def final_answers(events: DataFrame, run: list[str], seq: str, event: str) -> DataFrame:
    """(run, answer, source): a run's answer from its trace.

    The last structured tool input with an answer, else the last successful
    result, else the last answer file written, else the last assistant text.
    """
    v = F.try_parse_json(F.col(event))
    rows = events.select(*run, F.col(seq).alias("seq"), v.alias("v"))
    v = F.col("v")
    blocks = F.try_variant_get(v, "$.message.content", "array<variant>")
    tool = F.get(F.filter(blocks, lambda b: (F.try_variant_get(b, "$.type", "string") == "tool_use") & F.try_variant_get(b, "$.input.answer", "variant").isNotNull()), 0)
    structured = F.to_json(F.try_variant_get(tool, "$.input", "variant"))
    ok = (text_at(v, "type") == "result") & (text_at(v, "subtype") == "success")
    result = F.when(ok, F.coalesce(F.to_json(F.try_variant_get(v, "$.structured_output", "variant")), block_text(v, "result")))
    written = F.when(F.try_variant_get(v, "$.part.state.input.filePath", "string").endswith("output/answer.json"), F.try_variant_get(v, "$.part.state.input.content", "string"))
    cells = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("source"), c.alias("t")) for p, n, c in ((4, "structured", structured), (3, "result", result), (2, "file", written), (1, "text", assistant_text(v)))])
    found = rows.select(*run, "seq", F.explode(F.filter(cells, lambda c: c["t"].isNotNull())).alias("c"))
    return found.groupBy(*run).agg(F.max(F.struct("c.p", "seq", F.col("c.t").alias("t"), F.col("c.source").alias("s"))).alias("m")).select(*run, F.col("m.t").alias("answer"), F.col("m.s").alias("source"))
