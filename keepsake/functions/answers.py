"""Answer text as column expressions: normalisation, tokens for dates, times, numbers and codes.

All functions take and return columns and are made of built-in expressions. A
null text gives a null scalar and an empty array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Values that results depend on: word lists, lookup tables, patterns.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6,
    "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11,
    "december": 12, "dec": 12,
}
STOPWORDS = "the a an of in at on for to and or by from with into is was were be been being".split()
ADDRESS_KEYWORDS = (
    "street st road rd lane ln avenue ave drive dr place pl square sq close court ct way high highstreet boulevard blvd "
    "city town village county country oxford cambridge"
).split()
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty"
).split()
WEEKDAYS = "monday mon tuesday tue tues wednesday wed thursday thu thurs friday fri saturday sat sunday sun".split()
ABSTENTIONS = ["unknown", "abstention", "no information", "not available", "no evidence", "no evidnece", "insufficient information"]
VERBS = "am is are was were be been being has have had do does did".split()
CONTEXT_PATTERNS = [
    r"\bit happened on\b", r"\bstarting at\b", r"\bfrom\s+\d", r"\bonwards\b", r"\btotaling\b", r"\bcomprising\b",
    r"\bwith pre-drinks at\b", r"\bwith pre-\w+\b", r"\band dinner at\b", r"\bdress code is\b", r"\bthe total cost was\b",
    r"\bcode:\s*", r"\bexpires?\s*",
]
_M = "|".join(MONTHS)
ISO_DATE = r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b"
COMPACT_DATE = r"\b((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\b"
MONTH_DAY = rf"(?i)\b({_M})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s*(\d{{4}}))?\b"
DAY_MONTH = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({_M})(?:,?\s*(\d{{4}}))?\b"
MONTH_RANGE = rf"(?i)\b({_M})\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*(?:-|to|–)\s*(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s*(\d{{4}}))?\b"
TIME_RANGE = r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\s*(?:-|to|–|and)\s*(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\b"
TIME_12H = r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)\b"
TIME_24H = r"\b([01]?\d|2[0-3]):([0-5]\d)\b"
TIME_DOTTED = r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*(a\.m\.|p\.m\.)\b"
NUMBER = r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b"
AMOUNT_AFTER_SYMBOL = r"[£$€]\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)"
AMOUNT_BEFORE_CODE = r"(?i)(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*(?:USD|GBP|EUR|AUD|JOD|dollars?|pounds?|euros?)\b"
CURRENCY_CODE = r"(?i)\b(USD|GBP|EUR|AUD|JOD)\b"
CURRENCY_WORD = r"(?i)\b(dollars?|usd|pounds?|gbp|euros?|eur)\b"
CURRENCY_ANY = r"(?i)\b(usd|gbp|eur|aud|jod|dollars?|pounds?|euros?)\b"
CONNECTORS = r"(?i)\b(on|at|from|to|between|and|or|around|about|approx|approximately|before|after|until|till|by|in|of|for)\b"
CODE = r"(?i)\b[A-Z0-9]{4,}\b"
MEDIA_ID = r"\b(\d{8}_\d{6})\b"
MAIL_ID = r"(?i)\b(email\d+)\b"
POSTCODE_UK = r"(?i)\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b"
ZIP_US = r"\b\d{5}(?:-\d{4})?\b"
EDGE = "\t\n\r \"'`.,;:!?()[]{}"
# -----------------------------------------------------------------------------

_SPACE = r"[\s  -   　]+"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it, and outside of generated code, for which many paths are too long."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def squeeze(c: Column) -> Column:
    """One blank for every run of white space, none outside."""
    return F.trim(_sub(c, _SPACE, " "))


def aggressive(c: Column) -> Column:
    """Trailing full stops, commas inside numbers and unit words after numbers go."""
    c = _sub(c, r"\.+$")
    c = _sub(c, r"(\d),(\d)", "$1$2")
    return _sub(c, r"(?i)\b(\d+)\s+(spots?|hours?|sessions?|days?)\b", "$1")


def normalise_text(c: Column) -> Column:
    """Lower case, single blanks, no ordinals, brackets, number commas or outer punctuation."""
    c = squeeze(F.lower(c))
    c = _sub(c, r"\b(\d+)(st|nd|rd|th)\b", "$1")
    c = _sub(_sub(c, r"\([^)]+\)"), _SPACE, " ")
    c = _sub(c, r"(\d),(\d)", "$1$2")
    return F.btrim(c, F.lit(EDGE))


def without_brackets(c: Column) -> Column:
    return squeeze(_sub(c, r"\([^)]+\)"))


def without_breakdowns(c: Column) -> Column:
    """Tails that itemise an amount go; a session of so many minutes is a session."""
    c = _sub(c, r"(?i),?\s*totaling\s+[£$€]\d+(?:\.\d+)?\s+for\s+\w+\s+sessions?")
    c = _sub(c, r"(?i),?\s*comprising\s+.*$")
    return squeeze(_sub(c, r"(?i)per\s+\d+[- ]minute\s+session", "per session"))


def between_to_range(c: Column) -> Column:
    return _sub(_sub(c, r"(?i)\bbetween\s+"), r"(?i)\s+and\s+", " to ")


def without_article(c: Column) -> Column:
    return _sub(c, r"(?i)^\s*(a|an|the)\s+")


def without_context(c: Column) -> Column:
    """Phrases of circumstance and weekdays go."""
    c = reduce(lambda x, p: _sub(x, f"(?i){p}", " "), CONTEXT_PATTERNS, F.lower(c))
    return squeeze(_sub(c, rf"(?i)\b({'|'.join(WEEKDAYS)})\b", " "))


def abstains(c: Column) -> Column:
    return F.coalesce(let(normalise_text(c), lambda n: reduce(lambda a, b: a | b, [n.contains(p) for p in ABSTENTIONS])), F.lit(False))


def _month(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    return F.try_element_at(table, F.lower(name))


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("int").cast("string"), n, "0")


def _piece(m: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(m, pattern, group)


def date_tokens(c: Column) -> Column:
    """Dates as YYYYMMDD or MMDD, ranges as start-end: ISO, compact, month ranges, month-day and day-month, without repeats."""

    def whole(pattern: str, text: Column, y: int, mo, d: int) -> Column:
        def one(m: Column) -> Column:
            month = mo(m)
            year = _piece(m, pattern, y)
            day = F.concat(_pad(month, 2), _pad(_piece(m, pattern, d), 2))
            return F.when(year != "", F.concat(_pad(year, 4), day)).otherwise(day)

        return F.transform(_all(text, pattern), one)

    def span(m: Column) -> Column:
        year, month = _piece(m, MONTH_RANGE, 4), _pad(_month(_piece(m, MONTH_RANGE, 1)), 2)
        head = F.when(year != "", F.concat(_pad(year, 4), month)).otherwise(month)
        return F.concat(head, _pad(_piece(m, MONTH_RANGE, 2), 2), F.lit("-"), head, _pad(_piece(m, MONTH_RANGE, 3), 2))

    rest = _sub(c, MONTH_RANGE, " ")
    return F.array_distinct(
        F.concat(
            whole(ISO_DATE, c, 1, lambda m: _piece(m, ISO_DATE, 2), 3),
            whole(COMPACT_DATE, c, 1, lambda m: _piece(m, COMPACT_DATE, 2), 3),
            F.transform(_all(c, MONTH_RANGE), span),
            whole(MONTH_DAY, rest, 3, lambda m: _month(_piece(m, MONTH_DAY, 1)), 2),
            whole(DAY_MONTH, rest, 3, lambda m: _month(_piece(m, DAY_MONTH, 2)), 1),
        )
    )


def clock(hour: Column, minute: Column, half: Column) -> Column:
    """HH:MM from an hour, an optional minute and am, pm or nothing."""
    h = hour.cast("int")
    h = F.when(half == "", h).otherwise(F.when(h == 12, 0).otherwise(h) + F.when(half == "pm", 12).otherwise(0))
    m = F.when(minute == "", F.lit("00")).otherwise(F.lpad(minute, 2, "0"))
    return F.concat(F.when(h < 10, F.concat(F.lit("0"), h.cast("string"))).otherwise(h.cast("string")), F.lit(":"), m)


def time_tokens(c: Column) -> Column:
    """Times as HH:MM and ranges as start-end; a range's am or pm counts for its start too."""
    t = F.lower(c)
    for word, value in (("noon", "12:00"), ("midday", "12:00"), ("midnight", "00:00"), ("a.m.", "am"), ("p.m.", "pm"), ("a. m.", "am"), ("p. m.", "pm")):
        t = F.replace(t, F.lit(word), F.lit(value))

    def span(m: Column) -> Column:
        first, last = _piece(m, TIME_RANGE, 3), _piece(m, TIME_RANGE, 6)
        first = F.when(first == "", last).otherwise(first)
        start = clock(_piece(m, TIME_RANGE, 1), _piece(m, TIME_RANGE, 2), first)
        return F.concat(start, F.lit("-"), clock(_piece(m, TIME_RANGE, 4), _piece(m, TIME_RANGE, 5), last))

    rest = _sub(t, TIME_RANGE, " ")
    day = F.transform(_all(rest, TIME_24H), lambda m: clock(_piece(m, TIME_24H, 1), _piece(m, TIME_24H, 2), F.lit("")))
    half = F.transform(_all(rest, TIME_12H), lambda m: clock(_piece(m, TIME_12H, 1), _piece(m, TIME_12H, 2), _piece(m, TIME_12H, 3)))
    return F.array_distinct(F.concat(F.transform(_all(t, TIME_RANGE), span), day, half))


def without_dates_times(c: Column) -> Column:
    for p in (ISO_DATE, COMPACT_DATE, MONTH_RANGE, MONTH_DAY, DAY_MONTH, TIME_RANGE, TIME_24H, TIME_12H, TIME_DOTTED):
        c = _sub(c, p, " ")
    for word in ("noon", "midday", "midnight", "a.m.", "p.m.", "a. m.", "p. m."):
        c = F.replace(c, F.lit(word), F.lit(" "))
    return c


def number_words(c: Column) -> Column:
    """Number words up to twenty as digits; a word is known in any case but replaced in the case it has."""
    words = F.filter(F.array_distinct(_all(c, r"[a-zA-Z0-9]+")), lambda w: F.lower(w).isin(NUMBER_WORDS))
    index = F.array(*[F.lit(w) for w in NUMBER_WORDS])
    put = lambda s, w: F.regexp_replace(s, F.concat(F.lit(r"\b"), w, F.lit(r"\b")), (F.array_position(index, F.lower(w)) - 1).cast("string"))
    return F.when(F.size(words) > 0, F.aggregate(words, c, put)).otherwise(c)


def _decimals(strings: Column) -> Column:
    return F.transform(strings, lambda s: F.replace(s, F.lit(","), F.lit("")).try_cast("decimal(38,10)"))


def amounts(c: Column) -> Column:
    """Distinct money amounts, after a sign first, then before a code or word. At most three digits before a comma or point are read."""
    t = _sub(number_words(c), r"(\d),(\d)", "$1$2")
    return F.array_distinct(F.filter(_decimals(F.concat(_all(t, AMOUNT_AFTER_SYMBOL, 1), _all(t, AMOUNT_BEFORE_CODE, 1))), lambda d: d.isNotNull()))


def numbers(c: Column) -> Column:
    """Numbers of up to three digits, or with commas between groups of three, in order."""
    return F.filter(_decimals(_all(number_words(c), NUMBER)), lambda d: d.isNotNull())


def currencies(c: Column) -> Column:
    """Sorted distinct currency codes that the text names by code, word or sign."""
    named = F.transform(
        F.concat(_all(c, CURRENCY_CODE), _all(c, CURRENCY_WORD), _all(c, r"[£$€]")),
        lambda w: F.when(F.lower(w).rlike("^(usd|dollar)"), "USD").when(F.lower(w).rlike("^(gbp|pound)"), "GBP").when(F.lower(w).rlike("^eur"), "EUR")
        .when(w == "£", "GBP").when(w == "$", "USD").when(w == "€", "EUR").otherwise(F.upper(w)),
    )
    return F.array_sort(F.array_distinct(named))


def codes(c: Column) -> Column:
    """Distinct upper-case words of at least four letters and digits with both among them, ordinals excepted."""
    up = F.transform(_all(c, CODE), lambda w: F.upper(w))
    return F.array_distinct(F.filter(up, lambda w: w.rlike("[A-Z]") & w.rlike("[0-9]") & ~w.rlike(r"^\d{1,2}(ST|ND|RD|TH)$")))


def tokens(c: Column) -> Column:
    return _all(F.lower(c), "[a-z0-9]+")


def list_items(c: Column) -> Column:
    """Normalised items between commas, semicolons, slashes and the word and."""
    parts = F.filter(F.transform(F.split(c, r"(?i)\s*(?:,|;|\band\b|/)\s*"), lambda s: squeeze(s)), lambda s: s != "")
    return F.coalesce(F.transform(parts, normalise_text), F.array().cast("array<string>"))


def list_ids(c: Column) -> Column:
    """Media ids, then mail ids in lower case, without repeats."""
    return F.array_distinct(F.concat(_all(c, MEDIA_ID, 1), F.transform(_all(c, MAIL_ID, 1), lambda s: F.lower(s))))


def answer_items(c: Column) -> Column:
    ids = list_ids(c)
    return F.when(F.size(ids) > 0, ids).otherwise(F.filter(list_items(c), lambda s: s != ""))


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def content(c: Column) -> Column:
    """The distinct tokens that are no stop words."""
    return F.array_except(tokens(c), _strings(STOPWORDS))


def covers(have: Column, wanted: Column) -> Column:
    """Every one of ``wanted`` is among ``have``."""
    return F.size(F.array_except(wanted, have)) == 0


def token_subset(gt: Column, pred: Column) -> Column:
    """Every token of ``gt`` that is no stop word is in ``pred``; true if there is none."""
    return covers(tokens(pred), content(gt))


def names_place(have: Column, gt_content: Column) -> Column:
    """``gt_content`` has a word for a kind of place, and all of it but numbers is among the tokens ``have``."""
    rest = F.filter(gt_content, lambda w: ~w.rlike(r"^\d+$"))
    return F.arrays_overlap(gt_content, _strings(ADDRESS_KEYWORDS)) & (F.size(rest) > 0) & covers(have, rest)


def address_match(gt: Column, pred: Column) -> Column:
    """``gt`` names a kind of place, and all its tokens but stop words and numbers are in ``pred``."""
    return names_place(tokens(pred), content(gt))


def date_match(gt: Column, pred: Column) -> Column:
    """Two date tokens agree; a token without year is compared by month and day; ranges with ranges only."""

    def part(a: Column, b: Column) -> Column:
        return F.when((F.length(a) == 4) | (F.length(b) == 4), F.right(a, F.lit(4)) == F.right(b, F.lit(4))).otherwise(a == b)

    g, p = F.split(gt, "-"), F.split(pred, "-")
    return F.when(F.size(g) > 1, (F.size(p) > 1) & part(F.get(g, 0), F.get(p, 0)) & part(F.get(g, 1), F.get(p, 1))).otherwise(part(gt, pred))


def dates_match(gt: Column, pred: Column) -> Column:
    """Each date of ``gt`` takes the first agreeing one of ``pred`` that is left."""
    start = F.struct(F.lit(True).alias("ok"), pred.alias("left"))

    def take(state: Column, g: Column) -> Column:
        at = F.array_position(F.transform(state["left"], lambda p: date_match(g, p)), True)
        left = F.filter(state["left"], lambda _p, i: i != at - 1)
        return F.struct((state["ok"] & (at > 0)).alias("ok"), left.alias("left"))

    return F.aggregate(gt, start, take, lambda s: s["ok"])


def same_bag(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def jaccard(gt_items: Column, pred_items: Column) -> Column:
    """Shared items over all items; 1 if both are empty, 0 if only ``gt_items`` is."""
    g, p = F.array_distinct(gt_items), F.array_distinct(pred_items)
    union = F.size(F.array_union(g, p))
    return F.when(union == 0, 1.0).when(F.size(g) == 0, 0.0).otherwise(F.size(F.array_intersect(g, p)) / union)


def list_jaccard(gt: Column, pred: Column) -> Column:
    return jaccard(F.filter(list_items(gt), lambda s: s != ""), answer_items(pred))


def reference_date(question: Column) -> Column:
    """The first full date in a question, if it is a valid day."""
    return F.try_to_date(F.get(F.filter(date_tokens(question), lambda d: F.length(d) == 8), 0), "yyyyMMdd")


def resolve_relative(c: Column, day: Column) -> Column:
    """today, tonight, tomorrow and yesterday as month and day of ``day``; for each only the first casing found."""
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(n).alias("n")) for w, n in (("today", 0), ("tonight", 0), ("tomorrow", 1), ("yesterday", -1))])

    def put(text: Column, s: Column) -> Column:
        forms = [s["w"], F.initcap(s["w"]), F.upper(s["w"])]
        form = F.coalesce(*[F.when(text.contains(f), f) for f in forms])
        return F.coalesce(F.replace(text, form, F.date_format(F.date_add(day, s["n"]), "MMMM dd")), text)

    out = _sub(F.aggregate(words, c, put), r"(?i)(today|tonight|tomorrow|yesterday)\s*\([^)]+\)", "$1")
    return F.when(day.isNull(), c).otherwise(out)


def units_agree(gt: tuple[Column, ...], pred: tuple[Column, ...]) -> Column:
    """As ``units_match``, of (dates, times, amounts, content) of each text."""
    (gd, gt_t, ga, gc), (pd_, pr_t, pa, pc) = gt, pred
    tail = lambda a: F.transform(a, lambda d: F.right(d, F.lit(4)))
    long = lambda a: F.filter(a, lambda w: F.length(w) > 2)
    dates = (F.size(gd) == 0) | F.coalesce(F.arrays_overlap(tail(gd), tail(pd_)), F.lit(False))
    times = (F.size(gt_t) == 0) | (F.size(pr_t) == 0) | F.arrays_overlap(gt_t, pr_t)
    money = (F.size(ga) == 0) | (covers(pa, ga) & covers(ga, pa))
    words = F.size(F.array_intersect(long(gc), long(pc))) >= F.lit(0.8) * F.size(long(gc))
    return dates & times & money & words


def units_match(gt: Column, pred: Column) -> Column:
    """Dates share a month and day, times meet, amounts are equal, and 80 % of the long content tokens are shared."""
    units = lambda c: (date_tokens(c), time_tokens(c), amounts(c), content(c))
    return units_agree(units(gt), units(pred))


def shared_prep(c: Column) -> Column:
    return between_to_range(without_breakdowns(without_brackets(aggressive(c))))


def is_number_answer(c: Column) -> Column:
    """Nothing but dates, times, numbers, money and words that connect them."""

    def test(t: Column) -> Column:
        some = (F.size(date_tokens(t)) > 0) | (F.size(time_tokens(t)) > 0) | (F.size(numbers(t)) > 0) | (F.size(currencies(t)) > 0) | (F.size(amounts(t)) > 0)
        r = _sub(without_dates_times(t), rf"(?i)\b({'|'.join(WEEKDAYS)})\b", " ")
        for p in (CONNECTORS, CURRENCY_ANY, r"[£$€]", r"\d", r"[-–~/:,.;]"):
            r = _sub(r, p, " ")
        return (squeeze(r) == "") & some

    return F.coalesce((c != "") & ~abstains(c) & let(shared_prep(c), test), F.lit(False))


def is_id_list(c: Column) -> Column:
    """Nothing but media and mail ids with separators, at least one id."""
    r = _sub(_sub(c, r"\b\d{8}_\d{6}(?:_resized)?\b", " "), r"(?i)\bemail\d{12}\b", " ")
    return F.coalesce((r != c) & ~r.rlike("[A-Za-z0-9]"), F.lit(False))


def question_type(answer: Column, given: Column | None = None) -> Column:
    """number, list_recall or open_end: as given, else as the answer looks."""
    seen = F.when(is_number_answer(answer), "number").when(is_id_list(answer), "list_recall").otherwise("open_end")
    if given is None:
        return seen
    g = F.lower(squeeze(given))
    return (
        F.when(g.isin("number", "num", "numeric"), "number")
        .when(g.isin("list_recall", "list-recall", "list", "listrecall"), "list_recall")
        .when(g.isin("open_end", "open-end", "open", "openended", "open-ended", "open_ended"), "open_end")
        .otherwise(seen)
    )


def is_title_like(c: Column) -> Column:
    """At most 12 tokens, one with a letter, none a verb, at most 60 % stop words."""
    t = tokens(F.btrim(F.btrim(squeeze(c), F.lit("\"'`")), F.lit(" .,:;")))
    stops = F.size(F.filter(t, lambda w: w.isin(STOPWORDS)))
    return (F.size(t) > 0) & (F.size(t) <= 12) & F.exists(t, lambda w: w.rlike("[a-z]")) & ~F.arrays_overlap(t, _strings(VERBS)) & (stops <= F.lit(0.6) * F.size(t))


def is_location_like(c: Column) -> Column:
    """An address word, a postcode, or three or more short parts between commas."""
    low = F.lower(c)
    parts = F.filter(F.split(c, ","), lambda s: F.trim(s) != "")
    joined = low.contains(" and ") | low.contains(" or ") | low.contains(";") | low.contains("/")
    short = (F.size(parts) >= 3) & F.forall(parts, lambda s: F.size(tokens(s)) <= 3)
    return F.arrays_overlap(tokens(c), _strings(ADDRESS_KEYWORDS)) | c.rlike(POSTCODE_UK) | c.rlike(ZIP_US) | (~joined & short)


def safe_filename(c: Column) -> Column:
    return _sub(c, r"[^\p{L}\p{N}_-]", "_")


def unit_score(value: Column) -> Column:
    """A score in [0, 1] from a boolean, number or text; 0 where it is none."""
    v = F.lower(value.cast("string"))
    number = F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double"))
    return F.when(F.isnan(number), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(number, F.lit(0.0)))))
