"""Queries of the answer text functions and the deterministic scorer, with their SQL built from the same fixed patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import answers as A
from keepsake.operators import corpus, lookups, scoring
from keepsake.plans.registry import register
from keepsake.runtime import spread, table

# ------------------------------------------------------- SQL of the text functions


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(ws) -> str:
    return "[" + ", ".join(map(lit, ws)) + "]"


_SPACE = r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+"
_EDGE = "chr(9) || chr(10) || chr(13) || ' \"''`.,;:!?()[]{}'"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def every(x: str, pattern: str, group: int = 0) -> str:
    return f"coalesce(regexp_extract_all({x}, {lit(pattern)}, {group}), [])"


def piece(x: str, pattern: str, group: int) -> str:
    return f"regexp_extract({x}, {lit(pattern)}, {group})"


def chain(x: str, *steps: tuple[str, str]) -> str:
    for p, to in steps:
        x = sub(x, p, to)
    return x


def squeeze(x: str) -> str:
    return f"trim({sub(x, _SPACE, ' ')}, ' ')"


def aggressive(x: str) -> str:
    return chain(x, (r"\.+$", ""), (r"(\d),(\d)", r"\1\2"), (r"(?i)\b(\d+)\s+(spots?|hours?|sessions?|days?)\b", r"\1"))


def normalise_text(x: str) -> str:
    t = chain(squeeze(f"lower({x})"), (r"\b(\d+)(st|nd|rd|th)\b", r"\1"), (r"\([^)]+\)", ""), (_SPACE, " "), (r"(\d),(\d)", r"\1\2"))
    return f"trim({t}, {_EDGE})"


def without_breakdowns(x: str) -> str:
    t = chain(x, (r"(?i),?\s*totaling\s+[£$€]\d+(?:\.\d+)?\s+for\s+\w+\s+sessions?", ""), (r"(?i),?\s*comprising\s+.*$", ""), (r"(?i)per\s+\d+[- ]minute\s+session", "per session"))
    return squeeze(t)


def between_to_range(x: str) -> str:
    return chain(x, (r"(?i)\bbetween\s+", ""), (r"(?i)\s+and\s+", " to "))


def shared_prep(x: str) -> str:
    return between_to_range(without_breakdowns(squeeze(sub(aggressive(x), r"\([^)]+\)"))))


def without_article(x: str) -> str:
    return sub(x, r"(?i)^\s*(a|an|the)\s+")


def without_context(x: str) -> str:
    t = chain(f"lower({x})", *[(f"(?i){p}", " ") for p in A.CONTEXT_PATTERNS])
    return squeeze(sub(t, rf"(?i)\b({'|'.join(A.WEEKDAYS)})\b", " "))


def abstains(x: str) -> str:
    return f"coalesce(list_bool_or(list_transform({words(A.ABSTENTIONS)}, lambda a: contains({normalise_text(x)}, a))), false)"


def _pad(x: str) -> str:
    return f"lpad(cast(cast({x} as int) as varchar), 2, '0')"


def _month(x: str) -> str:
    return f"list_position({words([m for m in A.MONTHS if len(m) == 3])}, left(lower({x}), 3))"


def dates(x: str) -> str:
    """With repeats."""

    def whole(pattern: str, text: str, y: int, mo, d: int) -> str:
        p = lambda g: piece("m", pattern, g)
        return f"list_transform({every(text, pattern)}, lambda m: {p(y)} || {_pad(mo(p))} || {_pad(p(d))})"

    m = lambda g: piece("m", A.MONTH_RANGE, g)
    head = f"{m(4)} || {_pad(_month(m(1)))}"
    rest = sub(x, A.MONTH_RANGE, " ")
    return "list_concat(" + ", ".join([
        whole(A.ISO_DATE, x, 1, lambda p: p(2), 3), whole(A.COMPACT_DATE, x, 1, lambda p: p(2), 3),
        f"list_transform({every(x, A.MONTH_RANGE)}, lambda m: {head} || {_pad(m(2))} || '-' || {head} || {_pad(m(3))})",
        whole(A.MONTH_DAY, rest, 3, lambda p: _month(p(1)), 2), whole(A.DAY_MONTH, rest, 3, lambda p: _month(p(2)), 1),
    ]) + ")"


def _clock(h: str, mi: str, half: str) -> str:
    hour = f"case when {half} = '' then {h}::int else (case when {h}::int = 12 then 0 else {h}::int end) + case when {half} = 'pm' then 12 else 0 end end"
    return f"(lpad(({hour})::varchar, 2, '0') || ':' || case when {mi} = '' then '00' else lpad({mi}, 2, '0') end)"


def time_text(x: str) -> str:
    t = f"lower({x})"
    for word, value in (("noon", "12:00"), ("midday", "12:00"), ("midnight", "00:00"), ("a.m.", "am"), ("p.m.", "pm"), ("a. m.", "am"), ("p. m.", "pm")):
        t = f"replace({t}, '{word}', '{value}')"
    return t


def times(t: str) -> str:
    """Of the text ``time_text``, with repeats."""
    r = lambda g: piece("m", A.TIME_RANGE, g)
    first = f"coalesce(nullif({r(3)}, ''), {r(6)})"
    rest = sub(t, A.TIME_RANGE, " ")
    day, half = (lambda g, p=p: piece("m", p, g) for p in (A.TIME_24H, A.TIME_12H))
    return (
        f"list_concat(list_transform({every(t, A.TIME_RANGE)}, lambda m: {_clock(r(1), r(2), first)} || '-' || {_clock(r(4), r(5), r(6))}), "
        f"list_transform({every(rest, A.TIME_24H)}, lambda m: {_clock(day(1), day(2), lit(''))}), list_transform({every(rest, A.TIME_12H)}, lambda m: {_clock(half(1), half(2), half(3))}))"
    )


def unique(x: str) -> str:
    """Without repeats, in order; ``x`` should be a column."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def without_dates_times(x: str) -> str:
    x = chain(x, *[(p, " ") for p in (A.ISO_DATE, A.COMPACT_DATE, A.MONTH_RANGE, A.MONTH_DAY, A.DAY_MONTH, A.TIME_RANGE, A.TIME_24H, A.TIME_12H, A.TIME_DOTTED)])
    for w in ("noon", "midday", "midnight", "a.m.", "p.m.", "a. m.", "p. m."):
        x = f"replace({x}, '{w}', ' ')"
    return x


def number_words(x: str) -> str:
    return chain(x, *[(rf"(?i)\b{w}\b", str(i)) for i, w in enumerate(A.NUMBER_WORDS)])


def _decimals(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda s: try_cast(replace(s, ',', '') as decimal(38, 10))), lambda d: d is not null)"


def amounts(w: str) -> str:
    """Of the text ``number_words``, distinct and sorted."""
    t = sub(w, r"(\d),(\d)", r"\1\2")
    return f"list_sort(list_distinct({_decimals(f'list_concat({every(t, A.AMOUNT_AFTER_SYMBOL, 1)}, {every(t, A.AMOUNT_BEFORE_CODE, 1)})')}))"


def numbers(w: str) -> str:
    return _decimals(every(w, A.NUMBER))


def currencies(x: str) -> str:
    named = "case when regexp_matches(lower(w), '^(usd|dollar)') then 'USD' when regexp_matches(lower(w), '^(gbp|pound)') then 'GBP' when regexp_matches(lower(w), '^eur') then 'EUR' when w = '£' then 'GBP' when w = '$' then 'USD' when w = '€' then 'EUR' else upper(w) end"
    return f"list_sort(list_distinct(list_transform(list_concat({every(x, A.CURRENCY_CODE)}, {every(x, A.CURRENCY_WORD)}, {every(x, '[£$€]')}), lambda w: {named})))"


def codes(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform({every(x, A.CODE)}, lambda w: upper(w)), lambda w: regexp_matches(w, '[A-Z]') and regexp_matches(w, '[0-9]') and not regexp_matches(w, '^\\d{{1,2}}(ST|ND|RD|TH)$'))))"


def tokens(x: str) -> str:
    return every(f"lower({x})", "[a-z0-9]+")


def list_items(x: str) -> str:
    parts = f"regexp_split_to_array({x}, {lit(r'(?i)\s*(?:,|;|\band\b|/)\s*')})"
    return f"list_transform(list_filter(list_transform({parts}, lambda s: {squeeze('s')}), lambda s: s <> ''), lambda s: {normalise_text('s')})"


def list_ids(x: str) -> str:
    return f"list_distinct(list_concat({every(x, A.MEDIA_ID, 1)}, list_transform({every(x, A.MAIL_ID, 1)}, lambda s: lower(s))))"


def minus(a: str, b: str) -> str:
    return f"list_filter({a}, lambda y: not list_contains({b}, y))"


_STOP, _PLACE = words(A.STOPWORDS), words(A.ADDRESS_KEYWORDS)


def token_subset(g: str, p: str) -> str:
    return f"len({minus(minus(tokens(g), _STOP), tokens(p))}) = 0"


def address_match(g: str, p: str) -> str:
    rest = f"list_filter({minus(tokens(g), _STOP)}, lambda w: not regexp_matches(w, '^[0-9]+$'))"
    return f"(len(list_intersect({tokens(g)}, {_PLACE})) > 0 and len({rest}) > 0 and len({minus(rest, tokens(p))}) = 0)"


def _same_day(a: str, b: str) -> str:
    return f"case when length({a}) = 4 or length({b}) = 4 then right({a}, 4) = right({b}, 4) else {a} = {b} end"


def date_match(g: str, p: str) -> str:
    part = lambda x, n: f"split_part({x}, '-', {n})"
    return f"case when contains({g}, '-') then contains({p}, '-') and {_same_day(part(g, 1), part(p, 1))} and {_same_day(part(g, 2), part(p, 2))} else {_same_day(g, p)} end"


def dates_match(gd: str, pd: str) -> str:
    at = f"list_position(list_transform(s.rest, lambda p: {date_match('e.g', 'p')}), true)"
    step = f"{{'ok': s.ok and coalesce({at}, 0) > 0, 'rest': list_filter(s.rest, lambda p, i: i <> coalesce({at}, 0)), 'g': s.g}}"
    return f"(list_reduce(list_transform({gd}, lambda g: {{'ok': true, 'rest': {pd}, 'g': g}}), lambda s, e: {step}, {{'ok': true, 'rest': {pd}, 'g': ''}})).ok"


def units_match(g: str, p: str, gd: str, pd: str, gt: str, pt: str, ga: str, pa: str) -> str:
    tail = lambda a: f"list_transform({a}, lambda d: right(d, 4))"
    content = lambda x: f"list_distinct(list_filter({minus(tokens(x), _STOP)}, lambda w: length(w) > 2))"
    return (
        f"((len({gd}) = 0 or len(list_intersect({tail(gd)}, {tail(pd)})) > 0) and (len({gt}) = 0 or len({pt}) = 0 or len(list_intersect({gt}, {pt})) > 0)"
        f" and (len({ga}) = 0 or {ga} = {pa}) and (len({content(g)}) = 0 or len(list_intersect({content(g)}, {content(p)})) >= 0.8 * len({content(g)})))"
    )


def resolve(x: str, day: str, source: str) -> tuple[str, str]:
    """(ctes, last cte): column ``x`` of ``source`` with today, tonight, tomorrow and yesterday as dates."""
    ctes, last = "", source
    for i, (w, n) in enumerate((("today", 0), ("tonight", 0), ("tomorrow", 1), ("yesterday", -1))):
        form = " ".join(f"when contains({x}, '{f}') then '{f}'" for f in (w, w.capitalize(), w.upper()))
        ctes += f", {x}_{i} as (select * exclude ({x}), coalesce(replace({x}, case {form} end, strftime({day} + {n}, '%B %d')), {x}) as {x} from {last})\n"
        last = f"{x}_{i}"
    return ctes, last


def is_number_answer(c: str, t: str, dates_: str, times_: str, w: str) -> str:
    """``t`` is ``shared_prep`` of ``c``, ``w`` its ``number_words``; the other two are its tokens."""
    rest = chain(without_dates_times(t), (rf"(?i)\b({'|'.join(A.WEEKDAYS)})\b", " "), *[(p, " ") for p in (A.CONNECTORS, A.CURRENCY_ANY, r"[£$€]", r"\d", r"[-–~/:,.;]")])
    some = f"(len({dates_}) > 0 or len({times_}) > 0 or len({numbers(w)}) > 0 or len({currencies(t)}) > 0 or len({amounts(w)}) > 0)"
    return f"coalesce({c} <> '' and not {abstains(c)} and {some} and {squeeze(rest)} = '', false)"


def is_id_list(c: str) -> str:
    r = chain(c, (r"\b\d{8}_\d{6}(?:_resized)?\b", " "), (r"(?i)\bemail\d{12}\b", " "))
    return f"coalesce({r} <> {c} and not regexp_matches({r}, '[A-Za-z0-9]'), false)"


# --------------------------------------------------------------------- the queries

_PAIRS = """f as (select id, answer as truth from qa_annotations qualify row_number() over (partition by id order by ann_no) = 1),
given as (select ann_no, truth, answer as pred, question, qtype from qa_annotations join f using (id))
"""
_VARIANTS = """n as (select ann_no, question, qtype, answer as truth, coalesce(lag(answer) over (order by ann_no), '') as before from qa_annotations),
given as (select ann_no, truth, question, qtype, case ann_no % 7 when 0 then upper(truth) when 1 then 'the ' || lower(truth) || '.' when 2 then question || ' ' || truth when 3 then before
  when 4 then replace(truth, ',', ' and') when 5 then substr(truth, 1, length(truth) // 2) else replace(truth, ' ', '  ') || ' (about 10 km)' end as pred from n)
"""


def _cascade(given: str = _PAIRS) -> str:
    """CTEs from ``given`` (ann_no, truth, pred, question, qtype) to ``verdicts`` (ann_no, correct, normalised_prediction, the texts)."""
    day = f"list_filter({dates('coalesce(question, {})'.format(lit('')))}, lambda x: length(x) = 8)[1]"
    g_ctes, last = resolve("g", "day", "t1")
    p_ctes, last = resolve("p", "day", last)
    told = r"(?i)(today|tonight|tomorrow|yesterday)\s*\([^)]+\)"
    prep = lambda x: without_article(shared_prep(f"case when day is null then {x} else {sub(x, told, r'\1')} end"))
    return (
        f"""with {given}, t0 as (select ann_no, coalesce(truth, '') as g, coalesce(pred, '') as p, coalesce(truth, '') as g0, coalesce(pred, '') as p0, qtype, {day} as qday from given),
t1 as (select *, try_strptime(qday, '%Y%m%d')::date as day from t0)
{g_ctes}{p_ctes}, t2 as (select ann_no, qtype, g0, p0, {abstains('g0')} as ga, {abstains('p0')} as pa, {prep('g')} as g, {prep('p')} as p from {last}),
t3 as (select *, {normalise_text('g')} as gn, {normalise_text('p')} as pn, {codes('g')} as gc, {dates('g')} as gd_, {dates('p')} as pd_, {time_text('g')} as gl, {time_text('p')} as pl,
  {without_dates_times('g')} as gr, {without_dates_times('p')} as pr, {list_items('g')} as gi, {sub('upper(p)', r'\b(?:CODE|ID|REFERENCE|REF|NUMBER|NUM|LABEL):\s*')} as pu, {number_words('g')} as gw, {number_words('p')} as pw from t2),
t4 as (select *, {unique('gd_')} as gd, {unique('pd_')} as pd, {times('gl')} as gt_, {times('pl')} as pt_, {without_context(normalise_text('gr'))} as gx, {without_context(normalise_text('pr'))} as px,
  {currencies('gr')} as gcur, {currencies('pr')} as pcur, {number_words('gr')} as grw, {number_words('pr')} as prw from t3),
t5 as (select *, {unique('gt_')} as gt, {unique('pt_')} as pt, {amounts('grw')} as gam, {amounts('prw')} as pam, {numbers('grw')} as gnum, {numbers('prw')} as pnum, {amounts('gw')} as gall, {amounts('pw')} as pall from t4),
t6 as (select *, case when len(gam) > 0 then {minus('gnum', 'gam')} else gnum end as gno, case when len(gam) > 0 then {minus('pnum', 'pam')} else pnum end as pno from t5),
verdicts as (select ann_no, qtype, g0, p0, pn as normalised_prediction, case
  when ga or pa then ga and pa
  when len(list_filter(gc, lambda w: not contains(pu, w))) > 0 then false
  when len(gd) > 0 and not {dates_match('gd', 'pd')} then false
  when len(gt) > 0 and len(pt) > 0 and list_sort(gt) <> list_sort(pt) then false
  when (len(gd) > 0 or len(gt) > 0) and (gx = '' or {token_subset('gx', 'px')}) then true
  when len(gcur) > 0 and len(pcur) > 0 and gcur <> pcur then false
  when len(gam) > 0 and gam <> pam then false
  when len(gno) > 0 and list_sort(gno) <> list_sort(pno) then false
  when len(gi) >= 2 then len(list_filter(gi, lambda i: not contains(pn, i))) = 0
  when (starts_with(gn, 'yes') or starts_with(gn, 'no')) and pn in ('yes', 'no') then starts_with(gn, pn)
  when {address_match('g', 'p')} then true
  when length(gn) >= 3 and contains(pn, gn) then true
  when length(pn) >= 3 and contains(gn, pn) then true
  when {token_subset('g', 'p')} then true
  when {units_match('g', 'p', 'gd', 'pd', 'gt', 'pt', 'gall', 'pall')} then true
  else gn = pn end as correct from t6)
"""
    )


def _typed(source: str, text: str) -> str:
    """CTEs that end in ``typed`` (the rows of ``source`` with ``seen``, the type as ``text`` looks)."""
    return f"""y0 as (select *, {shared_prep(text)} as st from {source}),
y1 as (select *, {time_text('st')} as stl, {number_words('st')} as stw from y0),
typed as (select *, case when {is_number_answer(text, 'st', dates('st'), times('stl'), 'stw')} then 'number' when {is_id_list(text)} then 'list_recall' else 'open_end' end as seen from y1)
"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each annotation with the first answer to its question as ground truth."""
    rows = _qa(spark, d).select("ann_no", "id", "question", "answer", "qtype")
    first = lookups.first_by_key(rows.select("id", "ann_no", F.col("answer").alias("truth")), ["id"], ["ann_no"]).drop("ann_no")
    return rows.join(first, "id")


def _qa(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "qa_annotations"))


_X = "with a as (select ann_no, answer, question from qa_annotations where answer is not null)\n"


@register(_X + f""", b as (select ann_no, {dates('answer')} as d, {time_text('answer')} as t, {number_words('answer')} as w from a), c as (select *, {times('t')} as ts from b)
select ann_no, {unique('d')} as dates, {unique('ts')} as times, list_transform({numbers('w')}, lambda x: x::double) as numbers, list_transform({amounts('w')}, lambda x: x::double) as amounts from c""")
def answer_dates_times(spark: SparkSession, d: str) -> DataFrame:
    """Dates, times, numbers and (sorted) amounts of every answer."""
    a = F.col("answer")
    return _qa(spark, d).where("answer is not null").select("ann_no", A.date_tokens(a).alias("dates"), A.time_tokens(a).alias("times"), A.numbers(a).cast("array<double>").alias("numbers"), F.array_sort(A.amounts(a)).cast("array<double>").alias("amounts"))


@register("with a as (select ann_no, coalesce(answer, '') as answer from qa_annotations), " + _typed("a", "answer") + "select seen as type, count(*) as answers from typed group by seen")
def answer_types(spark: SparkSession, d: str) -> DataFrame:
    """How the answers look, given types aside."""
    rows = _qa(spark, d).select(A.question_type(F.coalesce("answer", F.lit(""))).alias("type"))
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("answers"))


@register("with a as (select ann_no, coalesce(answer, '') as answer, lower(trim(qtype)) as q from qa_annotations), " + _typed("a", "answer") + """select ann_no, case when q in ('number', 'num', 'numeric') then 'number' when q in ('list_recall', 'list-recall', 'list', 'listrecall') then 'list_recall'
  when q in ('open_end', 'open-end', 'open', 'openended', 'open-ended', 'open_ended') then 'open_end' else seen end as type, seen = 'number' as is_number, """ + is_id_list("answer") + " as is_list from typed")
def answer_type_of_row(spark: SparkSession, d: str) -> DataFrame:
    """The type of each pair, as given or else as its answer looks, and the tests behind it."""
    a = F.coalesce("answer", F.lit(""))
    return _qa(spark, d).select("ann_no", A.question_type(a, F.col("qtype")).alias("type"), A.is_number_answer(a).alias("is_number"), A.is_id_list(a).alias("is_list"))


@register(_cascade() + "select ann_no, correct, normalised_prediction from verdicts")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    return scoring.exact_match(_pairs(spark, d), "truth", "answer", "question").select("ann_no", "correct", "normalised_prediction")


@register(_cascade(_VARIANTS) + "select ann_no, correct, normalised_prediction from verdicts")
def exact_match_variants(spark: SparkSession, d: str) -> DataFrame:
    """Answers against changed forms of themselves and against the answer before, so that every rule has cases."""
    rows = _qa(spark, d).select("ann_no", "question", F.col("answer").alias("truth"))
    place = corpus.dense_index(rows.select("ann_no"), [F.col("ann_no")], "place")
    rows = rows.join(place, "ann_no")
    before = rows.select((F.col("place") + 1).alias("place"), F.col("truth").alias("before"))
    t = F.col("truth")
    forms = [F.upper(t), F.concat(F.lit("the "), F.lower(t), F.lit(".")), F.concat("question", F.lit(" "), t), F.coalesce("before", F.lit("")), F.replace(t, F.lit(","), F.lit(" and")), F.substring(t, F.lit(1), F.floor(F.length(t) / 2).cast("int"))]
    pred = F.concat(F.replace(t, F.lit(" "), F.lit("  ")), F.lit(" (about 10 km)"))
    for i, form in enumerate(forms):
        pred = F.when(F.col("ann_no") % 7 == i, form).otherwise(pred)
    rows = rows.join(before, "place", "left").withColumn("pred", pred)
    return scoring.exact_match(rows, "truth", "pred", "question").select("ann_no", "correct", "normalised_prediction")


_ITEMS = f"""z as (select *, list_distinct(list_filter({list_items('g0')}, lambda s: s <> '')) as gitems, {list_ids('p0')} as pids, list_filter({list_items('p0')}, lambda s: s <> '') as pitems from typed),
w as (select *, list_distinct(case when len(pids) > 0 then pids else pitems end) as pset,
  case when lower(trim(qtype)) in ('number', 'num', 'numeric') then 'number' when lower(trim(qtype)) in ('list_recall', 'list-recall', 'list', 'listrecall') then 'list_recall'
  when lower(trim(qtype)) in ('open_end', 'open-end', 'open', 'openended', 'open-ended', 'open_ended') then 'open_end' else seen end as type from z)
"""


_SCORED = _cascade() + ", " + _typed("verdicts", "g0") + ", " + _ITEMS + """select ann_no, type, case type when 'number' then 'em' when 'list_recall' then 'jaccard' else 'llm' end as metric,
  round(case type when 'number' then correct::int::double when 'open_end' then (lower(g0) = lower(p0))::int::double
    else case when len(gitems) + len(pset) = 0 then 1.0 when len(gitems) = 0 then 0.0 else len(list_intersect(gitems, pset)) / (len(gitems) + len(pset) - len(list_intersect(gitems, pset))) end end, 6) as accuracy from w"""


@register(_SCORED)
def score_answers(spark: SparkSession, d: str) -> DataFrame:
    """All three metrics by question type; a stand-in judge compares lower-cased texts."""
    judge = lambda f: (f["ground_truth"].fillna("").str.lower() == f["prediction"].fillna("").str.lower()).astype(float)
    scored = scoring.score_answers(_pairs(spark, d), "truth", "answer", "question", "qtype", judge)
    return scored.select("ann_no", "type", "metric", F.round("accuracy", 6).alias("accuracy"))


@register(f"""with x as ({_SCORED}), g as (select type as qtype, count(*) as count, sum(accuracy) as correct from x group by type union all select 'all', count(*), sum(accuracy) from x)
select qtype, coalesce(count, 0) as count, round(coalesce(correct, 0.0), 4) as correct, round(case when count > 0 then correct / count else 0.0 end, 6) as accuracy from (select unnest(['number', 'list_recall', 'open_end', 'all']) as qtype) left join g using (qtype)""")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    """The scores of ``score_answers`` by type and in all."""
    out = scoring.summarise_scores(score_answers(spark, d))
    return out.select("qtype", "count", F.round("correct", 4).alias("correct"), F.round("accuracy", 6).alias("accuracy"))
