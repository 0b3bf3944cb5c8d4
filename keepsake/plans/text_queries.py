"""Queries of the text functions. Where a function reads a form, the form is made of table columns by an expression that
both engines know, and the SQL gives what went into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import answers as A
from keepsake.functions import formats, jsontext
from keepsake.operators import corpus, ranking
from keepsake.plans import answer_queries as S
from keepsake.plans.registry import big, register
from keepsake.runtime import spread, table


def made(df: DataFrame, **forms: str) -> DataFrame:
    return df.select("*", *[F.expr(x).alias(n) for n, x in forms.items()])


# ----------------------------------------------------------------------- answer texts


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "qa_annotations").where("answer is not null").select("ann_no", "question", "answer"))


_MORE = """answer || case ann_no % 6 when 0 then ' (about 3 hours), between 2 and 4 sessions.' when 1 then ', totaling £45.50 for three sessions' when 2 then ' per 30-minute session, comprising 2 parts'
  when 3 then ', it happened on Monday 3 May 2021 at 4 pm' when 4 then ' and the 1,250 days; from 3 to 5 onwards' else ' no information' end"""
_FORMS = f"with a as (select ann_no, {_MORE} as t from qa_annotations where answer is not null)\n"


@register(_FORMS + f"""select ann_no, {S.aggressive('t')} as aggressive, {S.squeeze(S.sub('t', r'[(][^)]+[)]'))} as without_brackets, {S.without_breakdowns('t')} as without_breakdowns, {S.between_to_range('t')} as ranges,
  {S.without_article("'The ' || t")} as without_article, {S.without_context('t')} as without_context, {S.abstains('t')} as abstains, {S.without_dates_times('t')} as without_dates_times,
  {S.number_words("t || ' Three twenty'")} as number_words, {S.list_items('t')} as items from a""")
def answer_text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every step of the answer cleaning, on answers with tails that the steps are for."""
    t = F.col("t")
    return made(_answers(spark, d), t=_MORE).select(
        "ann_no", A.aggressive(t).alias("aggressive"), A.without_brackets(t).alias("without_brackets"), A.without_breakdowns(t).alias("without_breakdowns"), A.between_to_range(t).alias("ranges"),
        A.without_article(F.concat(F.lit("The "), t)).alias("without_article"), A.without_context(t).alias("without_context"), A.abstains(t).alias("abstains"), A.without_dates_times(t).alias("without_dates_times"),
        A.number_words(F.concat(t, F.lit(" Three twenty"))).alias("number_words"), A.list_items(t).alias("items"),
    )


_DATES = """case ann_no % 5 when 0 then 'on 3 March 2021 at 4:30 pm' when 1 then 'March 3rd, 14:05' when 2 then '2021-03-03, from 3 to 5 pm' when 3 then 'March 3-5, 2021, USD 45.50' else '20210303 and 4 April, £12' end"""
_OTHER = _DATES.replace("ann_no % 5", "(ann_no + ann_no // 5) % 5")
_OTHER_SPARK = _DATES.replace("ann_no % 5", "(ann_no + ann_no div 5) % 5")


@register(f"""with a as (select ann_no, answer || ' ' || {_DATES} as g, answer || ' in Church Street ' || {_OTHER} as p from qa_annotations where answer is not null),
b as (select *, {S.dates('g')} as gd_, {S.dates('p')} as pd_, {S.time_text('g')} as gl, {S.time_text('p')} as pl, {S.number_words('g')} as gw, {S.number_words('p')} as pw from a),
c as (select *, {S.unique('gd_')} as gd, {S.unique('pd_')} as pd, {S.times('gl')} as gt_, {S.times('pl')} as pt_, {S.amounts('gw')} as ga, {S.amounts('pw')} as pa from b),
z as (select *, {S.unique('gt_')} as gt, {S.unique('pt_')} as pt from c)
select ann_no, {S.dates_match('gd', 'pd')} as dates_match, {S.units_match('g', 'p', 'gd', 'pd', 'gt', 'pt', 'ga', 'pa')} as units_match, {S.address_match('p', 'g')} as address_match,
  coalesce({S.date_match('gd[1]', 'pd[1]')}, false) as first_match, {S.codes("upper(g) || ' AB12CD'")} as codes from z""")
def answer_pair_matches(spark: SparkSession, d: str) -> DataFrame:
    """Dates, units and addresses of pairs of texts."""
    rows = made(_answers(spark, d), g=f"answer || ' ' || {_DATES}", p=f"answer || ' in Church Street ' || {_OTHER_SPARK}")
    g, p = F.col("g"), F.col("p")
    rows = rows.select("ann_no", "g", "p", A.date_tokens(g).alias("gd"), A.date_tokens(p).alias("pd"))
    first = A.date_match(F.get("gd", F.lit(0)), F.get("pd", F.lit(0)))
    return rows.select(
        "ann_no", A.dates_match(F.col("gd"), F.col("pd")).alias("dates_match"), A.units_match(g, p).alias("units_match"), A.address_match(p, g).alias("address_match"),
        F.coalesce(first, F.lit(False)).alias("first_match"), F.array_sort(A.codes(F.concat(F.upper(g), F.lit(" AB12CD")))).alias("codes"),
    )


_ASKED = "question || case ann_no % 3 when 0 then ' (asked on 2021-02-27)' when 1 then ' (asked on 3 May 2021)' else ' (2021-02-30)' end"
_TOLD = "case ann_no % 4 when 0 then 'Today at noon and TOMORROW (Sunday)' when 1 then 'yesterday, ' || answer when 2 then 'Tonight (late) or tomorrow' else answer end"


@register(f"with a as (select ann_no, list_filter({S.dates(_ASKED)}, lambda x: length(x) = 8)[1] as qday, {_TOLD} as t from qa_annotations where answer is not null and question is not null), "
          "b as (select *, try_strptime(qday, '%Y%m%d')::date as day from a)\n" + S.resolve("t", "day", "b")[0]
          + f"select ann_no, day, case when day is null then t else {S.sub('t', r'(?i)(today|tonight|tomorrow|yesterday)\s*\([^)]+\)', r'\1')} end as text from {S.resolve('t', 'day', 'b')[1]}")
def relative_dates(spark: SparkSession, d: str) -> DataFrame:
    """The day that a question names, and the days told relative to it."""
    rows = made(_answers(spark, d).where("question is not null"), q=_ASKED, t=_TOLD).select("ann_no", "t", A.reference_date(F.col("q")).alias("day"))
    return rows.select("ann_no", "day", A.resolve_relative(F.col("t"), F.col("day")).alias("text"))


_LIST = "answer || case ann_no % 3 when 0 then '' when 1 then ', 20210304_101112 and Email202103041011, email1' else ' / b; c' end"


@register(f"""with a as (select ann_no, {_LIST} as t, question as g from qa_annotations where answer is not null and question is not null),
b as (select *, {S.list_ids('t')} as ids, list_filter({S.list_items('t')}, lambda s: s <> '') as items, list_distinct(list_filter({S.list_items('g')}, lambda s: s <> '')) as gs from a),
c as (select ann_no, gs, list_distinct(case when len(ids) > 0 then ids else items end) as ps, list_sort(case when len(ids) > 0 then ids else items end) as answer_items from b)
select ann_no, answer_items, round(case when len(gs) + len(ps) = 0 then 1.0 when len(gs) = 0 then 0.0 else len(list_intersect(gs, ps)) / (len(gs) + len(ps) - len(list_intersect(gs, ps))) end, 6) as jaccard from c""")
def answer_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = made(_answers(spark, d).where("question is not null"), t=_LIST)
    return rows.select("ann_no", F.array_sort(A.answer_items(F.col("t"))).alias("answer_items"), F.round(A.list_jaccard(F.col("question"), F.col("t")), 6).alias("jaccard"))


_VERBS = S.words(A.VERBS)
_TITLE = f"trim(trim({S.squeeze('t')}, '\"''`'), ' .,:;')"


@register(f"""with a as (select idx, coalesce(title, '') || case idx % 4 when 0 then '' when 1 then ', High Street, OX1 2AB' when 2 then ', Berlin, Germany' else ' is here' end as t from text_passages),
b as (select *, {S.tokens(_TITLE)} as w, list_filter(string_split(t, ','), lambda s: trim(s, ' ') <> '') as parts from a)
select idx, len(w) > 0 and len(w) <= 12 and len(list_filter(w, lambda x: regexp_matches(x, '[a-z]'))) > 0 and len(list_intersect(w, {_VERBS})) = 0 and len(list_filter(w, lambda x: list_contains({S._STOP}, x))) <= 0.6 * len(w) as title_like,
  len(list_intersect({S.tokens('t')}, {S._PLACE})) > 0 or regexp_matches(t, {S.lit(A.POSTCODE_UK)}) or regexp_matches(t, {S.lit(A.ZIP_US)})
    or (not (contains(lower(t), ' and ') or contains(lower(t), ' or ') or contains(t, ';') or contains(t, '/')) and len(parts) >= 3 and len(list_filter(parts, lambda s: len({S.tokens('s')}) > 3)) = 0) as location_like from b""")
def title_and_location_tests(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.coalesce("title", F.lit("")), F.expr("case idx % 4 when 0 then '' when 1 then ', High Street, OX1 2AB' when 2 then ', Berlin, Germany' else ' is here' end"))
    rows = table(spark, d, "text_passages").select("idx", t.alias("t"))
    return rows.select("idx", A.is_title_like(F.col("t")).alias("title_like"), A.is_location_like(F.col("t")).alias("location_like"))


@register("""with a as (select event_id, case event_id % 6 when 0 then 'true' when 1 then 'FALSE' when 2 then value::decimal(10, 2)::varchar when 3 then 'x' when 4 then null else '0.25' end as s from events)
select event_id, case when s is null then 0.0 when lower(s) = 'true' then 1.0 when lower(s) = 'false' then 0.0 else least(1.0, greatest(0.0, coalesce(try_cast(s as double), 0.0))) end as score from a""")
def unit_scores(spark: SparkSession, d: str) -> DataFrame:
    s = F.expr("case event_id % 6 when 0 then 'true' when 1 then 'FALSE' when 2 then cast(cast(value as decimal(10, 2)) as string) when 3 then 'x' when 4 then null else '0.25' end")
    return table(spark, d, "events").select("event_id", A.unit_score(s).alias("score"))


# --------------------------------------------------------------------------- formats

_SENDER = """case contact_no % 5 when 0 then given_name || ' ' || family_name || ' <' || given_name || '.' || family_name || '@mail.test>' when 1 then given_name || '_' || family_name || '@mail.test'
  when 2 then 'x@mail.test (' || given_name || ')' when 3 then '"' || family_name || '" <y' || contact_no || '@mail.test>' else family_name end"""


@register(f"""with c as (select *, {_SENDER} as s from contacts where given_name is not null and family_name is not null)
select contact_no, case contact_no % 5 when 0 then given_name || '.' || family_name || '@mail.test' when 1 then s when 2 then 'x@mail.test' when 3 then 'y' || contact_no || '@mail.test' else trim(family_name) end as address,
  case contact_no % 5 when 0 then trim(given_name || ' ' || family_name) when 1 then upper(given_name[1]) || lower(given_name[2:]) || ' ' || upper(family_name[1]) || lower(family_name[2:]) when 2 then trim(given_name) else trim(family_name) end as name from c""")
def mail_senders(spark: SparkSession, d: str) -> DataFrame:
    c = made(table(spark, d, "contacts").where("given_name is not null and family_name is not null"), s=_SENDER)
    return c.select("contact_no", formats.mail_address(F.col("s")).alias("address"), formats.sender_name(F.col("s")).alias("name"))


_EML = """'From: ' || given_name || ' <a@b.test>' || chr(13) || chr(10) || 'Subject: Trip ' || contact_no || chr(13) || chr(10) || chr(9) || 'to the sea' || chr(13) || chr(10) || 'X-Note: one' || chr(10) || 'x-note: two: ' || family_name
 || chr(10) || 'Date: ' || case contact_no % 3 when 0 then 'Mon, 3 May 2021 10:11:12 +0200' when 1 then '2021-05-03 10:11:12' else '5/3/2021, 10:11 AM' end
 || chr(10) || chr(10) || 'Dear  ' || family_name || ',' || chr(10) || 'see Attachment: plan' || contact_no || '.pdf' || chr(10) || 'ID: m' || contact_no"""


@register("""select contact_no, given_name || ' <a@b.test>' as sender, 'Trip ' || contact_no || ' to the sea' as subject, 'two: ' || family_name as note, 'Dear ' || family_name || ', see Attachment: plan' || contact_no || '.pdf ID: m' || contact_no as body,
  ['plan' || contact_no || '.pdf'] as files, case contact_no % 3 when 2 then timestamp '2021-05-03 10:11:00' else timestamp '2021-05-03 10:11:12' end as sent, 'Trip ' || contact_no as first_subject, 'm' || contact_no as id
from contacts where given_name is not null and family_name is not null""")
def mail_files_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Headers with continuation lines and repeats, body, attachments, dates and labelled lines of mails."""
    m = made(table(spark, d, "contacts").where("given_name is not null and family_name is not null"), m=_EML)
    h = formats.mail_headers(F.col("m"))
    return m.select(
        "contact_no", h["from"].alias("sender"), h["subject"].alias("subject"), h["x-note"].alias("note"), formats.mail_body(F.col("m")).alias("body"), formats.attachments(F.col("m")).alias("files"),
        formats.mail_date(h["date"]).alias("sent"), corpus.mail_subject(F.regexp_replace("m", "\r", "")).alias("first_subject"), formats.id_line(F.col("m")).alias("id"),
    )


@register("""select event_id, [((event_id % 180) - 90 + 0.25)::double, ((event_id * 7) % 360 - 180 + 0.5)::double] as place, round((event_id % 90 + event_id % 60 / 60.0 + event_id % 50 / 3600.0) * case when event_id % 2 = 0 then -1 else 1 end, 6) + 0.0 as degrees,
  null::double[] as nowhere from events""")
def places_on_earth(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates from signed texts and from degrees, minutes and seconds."""
    e = table(spark, d, "events").select("event_id", F.expr("format_string('%+09.4f%+010.4f/', cast((event_id % 180) - 90 + 0.25 as double), cast((event_id * 7) % 360 - 180 + 0.5 as double))").alias("t"))
    n = F.col("event_id")
    deg = formats.degrees((n % 90).cast("double"), (n % 60).cast("double"), (n % 50).cast("double"), F.when(n % 2 == 0, "s").otherwise("N"))
    return e.select("event_id", F.transform(formats.gps_pair(F.col("t")), lambda x: F.round(x, 6)).alias("place"), F.round(deg, 6).alias("degrees"), formats.gps_pair(F.lit("+95.0+010.0/")).alias("nowhere"))


@register("""with s as (select event_id, (event_id * 37) % 200000 + 0.37 as s, (event_id * 37) % 200000 as n from events)
select event_id, case when n >= 3600 then (n // 3600) || 'h' || lpad(((n % 3600) // 60)::varchar, 2, '0') || 'm' when n >= 60 then (n // 60) || 'm' || lpad((n % 60)::varchar, 2, '0') || 's' else n || 's' end as compact,
  case when s < 60 then printf('%.1f', s::double) || 's' when s < 3600 then (n // 60) || 'm ' || (n % 60) || 's' else (n // 3600) || 'h ' || ((n % 3600) // 60) || 'm' end as words,
  case when s < 60 then printf('%.0f', s::double) || 's' when s < 3600 then printf('%.1f', s::double / 60) || 'm' when s < 86400 then printf('%.1f', s::double / 3600) || 'h' else printf('%.1f', s::double / 86400) || 'd' end as eta,
  printf('%.1f', s::double / 200001 * 100) as percent from s""")
def durations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", ((F.col("event_id") * 37) % 200000 + F.lit(0.37)).cast("double").alias("s"))
    s = F.col("s")
    return e.select("event_id", formats.duration_compact(s).alias("compact"), formats.duration_words(s).alias("words"), formats.eta(s).alias("eta"), formats.percent(s / 200001).alias("percent"))


@register("""select note_no, 'n ' || note_no as bracket, ['a' || note_no, 'b', 'c'] as sources, ['n ' || note_no] as one_source, 'i' || note_no as line, 'x' || note_no || '.jpg' as bare, 'b c' as clean, 'a_b-' || note_no || '_jpg' as file,
  substr(sha256('s' || note_no || '7'), 1, 24) as chunk, 'it ' || note_no as uri, 'f' || note_no as stem, strftime(make_timestamp(1600000000000000 + note_no * 1000003), '%Y-%m-%d %H:%M:%S') as told from memory_notes""")
def ids_in_texts(spark: SparkSession, d: str) -> DataFrame:
    """Ids in brackets, lists, lines and paths, as notes, chunks and files carry them."""
    n = F.col("note_no").cast("string")
    t = lambda *p: F.concat(*[n if x is n else F.lit(x) for x in p])
    return table(spark, d, "memory_notes").select(
        "note_no", formats.bracket_id(t("see [ n ", n, " ] and [z]")).alias("bracket"), formats.source_ids(t("x [SOURCE_ID: a", n, ", b; b] y [source_id:c]")).alias("sources"), formats.source_ids(t("[n ", n, "] w")).alias("one_source"),
        formats.id_line(t("Head\nID: i", n, " \nTail")).alias("line"), formats.bare_evidence_id(t("Image_x", n, ".jpg")).alias("bare"), formats.clean_text(F.lit("b\x00 \n c")).alias("clean"), A.safe_filename(t("a b-", n, ".jpg")).alias("file"),
        ranking.chunk_id(t("s", n), F.lit(7)).alias("chunk"), corpus.item_of_uri(t("memory://it ", n), "memory://").alias("uri"), corpus.item_of_uri(t("/a/b/f", n, ".txt"), "memory://").alias("stem"),
        formats.time_text(F.timestamp_micros(F.col("note_no") * 1000003 + 1600000000000000)).alias("told"),
    )


@register("""with n as (select note_no, coalesce(tags, []) as t from memory_notes)
select note_no, [lower(trim(x)) for x in t if trim(x) <> ''][:3] as tags, list_sort(list_distinct([lower(trim(x)) for x in t if length(trim(x)) > 1])) as tag_set, ['Anna ' || note_no, 'Sea'] as entities, ['person', 'place'] as kinds from n""")
def tags_and_entities(spark: SparkSession, d: str) -> DataFrame:
    """Tag lists, sets and entity lines, the first of each name and type."""
    rows = table(spark, d, "memory_notes").select("note_no", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " , ").alias("t"), F.concat(F.lit("- Anna "), F.col("note_no").cast("string"), F.lit(": person\nnothing\n* Sea: place\nsea: place\n: odd")).alias("e"))
    e = formats.first_entities(formats.entity_lines(F.col("e")))
    return rows.select("note_no", formats.tag_list(F.col("t"), 3).alias("tags"), formats.tag_set(F.col("t")).alias("tag_set"), F.transform(e, lambda x: x["entity"]).alias("entities"), F.transform(e, lambda x: x["type"]).alias("kinds"))


# ------------------------------------------------------------------------ JSON in text

_OBJECT = """'{"a": ' || event_id || ', "s": "x}{' || event_type || '", "in": {"b": [1, {"c": 2}]}}'"""


@register(f"""select event_id, {_OBJECT} as first, {_OBJECT} as blob, '{{"a": ' || event_id || ', "s": "x}}' as naive, {_OBJECT} as fenced, null::varchar as none from events""")
def json_objects_in_text(spark: SparkSession, d: str) -> DataFrame:
    """The first balanced object, with and without regard to strings, also in fences."""
    e = made(table(spark, d, "events"), o=_OBJECT)
    around = F.concat(F.lit("Sure: "), F.col("o"), F.lit(" and } more {\"z\": 1}"))
    fence = F.concat(F.lit("```json\n"), F.col("o"), F.lit("\n```"))
    naive = jsontext.scalar(lambda t: jsontext.first_object(t, aware=False))
    return e.select("event_id", jsontext.first_json_object(around).alias("first"), jsontext.json_object_of(around).alias("blob"), naive(around).alias("naive"), jsontext.json_object_of(fence).alias("fenced"), jsontext.first_json_object(F.lit("no { end")).alias("none"))


_ENTRY = """'{"lossless_restatement": "r' || note_no || '", "n": ' || note_no || '}'"""


@register(f"""select note_no, case when note_no % 5 = 4 then null else [{_ENTRY}, {_ENTRY}] end as entries from memory_notes""")
def memory_payloads_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Memory payloads as fenced arrays, wrapped arrays, arrays in prose, single objects, and none."""
    n = made(table(spark, d, "memory_notes").select("note_no"), e=_ENTRY)
    e = F.col("e")
    pair = F.concat(F.lit("["), e, F.lit(", "), e, F.lit("]"))
    k = F.col("note_no") % 5
    t = (
        F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), pair, F.lit("\n```"))).when(k == 1, F.concat(F.lit('{"memory_entries": '), pair, F.lit("}"))).when(k == 2, F.concat(F.lit("I found "), pair, F.lit(" in all")))
        .when(k == 3, F.concat(F.lit("One "), e, F.lit(" two "), e, F.lit(" [broken"))).otherwise("nothing {here")
    )
    return n.select("note_no", jsontext.memory_payload(t).alias("entries"))


_SAID = """case ann_no % 4 when 0 then 'Fully supported' when 1 then 'partial' when 2 then 'no support' else 'odd' end"""


@register(f"""select ann_no, 'a' || ann_no as final_answer, case ann_no % 4 when 0 then 'fully' when 1 then 'partially' when 2 then 'none' end as support, case when ann_no % 7 = 6 then null else least(5, greatest(1, ann_no % 7))::bigint end as utility,
  case when ann_no % 4 = 2 then 'Unknown' else 'a' || ann_no end as answer from qa_annotations""")
def critic_replies(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qa_annotations").select("ann_no", F.expr(f"""'```json' || chr(10) || '{{"final_answer": " a' || ann_no || ' ", "support": "' || {_SAID} || '", "utility": ' || case when ann_no % 7 = 6 then 'null' else cast(ann_no % 7 as string) end || '}}' || chr(10) || '```'""").alias("t"))
    c = q.select("ann_no", jsontext.critic(F.col("t")).alias("c"))
    return c.select("ann_no", "c.final_answer", "c.support", big(F.col("c.utility")).alias("utility"), jsontext.critic_answer(F.lit("old"), F.col("c")).alias("answer"))


_REPLY = """case ann_no % 5 when 0 then 'Well: {"accuracy": true, "explanation": "e' || ann_no || '"} done' when 1 then '{"accuracy": false, "explanation": "n"}' when 2 then 'The answer is incorrect.' when 3 then '{"accuracy": 0.5}' else 'Nothing fits' end"""


@register(f"""select ann_no, [1.0, 0.0, 1.0, 0.5, 0.0][ann_no % 5 + 1]::double as accuracy, case ann_no % 5 when 0 then 'e' || ann_no when 1 then 'n' when 2 then 'The answer is incorrect.' when 4 then 'Nothing fits' end as explanation, ann_no % 5 in (2, 4) as fallback,
  [1.0, 0.0, 0.0, 0.5, 0.0][ann_no % 5 + 1]::double as strict from qa_annotations""")
def judge_replies(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of judges: JSON, words, and words with negations seen first."""
    r = made(table(spark, d, "qa_annotations").select("ann_no"), r=_REPLY)
    return r.select("ann_no", jsontext.judge_verdict(F.col("r")).alias("v"), jsontext.judge_verdict(F.col("r"), literal=False)["accuracy"].alias("strict")).select("ann_no", "v.*", "strict")


_HTML = """'<html><head><title>T' || contact_no || '</title><style>p {}</style></head><body><script>x()</script><table><tr><td><b>From:</b></td><td>' || given_name || '</td></tr><tr><td>Sent</td><td>3 May</td></tr></table><p>Hello &amp;  ' || family_name || '</p><!-- no --></body></html>'"""


@register("""select contact_no, 'T' || contact_no || ' From: ' || given_name || ' Sent 3 May Hello & ' || family_name as text, given_name as sender, '3 May' as sent, 'T' || contact_no as subject from contacts where given_name is not null and family_name is not null""")
def html_mails(spark: SparkSession, d: str) -> DataFrame:
    """Text and headers of mails in HTML."""
    h = made(table(spark, d, "contacts").where("given_name is not null and family_name is not null"), h=_HTML)
    m = h.select("contact_no", jsontext.text_of_html(F.col("h")).alias("text"), jsontext.headers_of_html(F.col("h")).alias("m"))
    return m.select("contact_no", "text", F.col("m")["sender"].alias("sender"), F.col("m")["date"].alias("sent"), F.col("m")["subject"].alias("subject"))

