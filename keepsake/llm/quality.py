"""Per-document text statistics and learned rules that tell prose from lists, tables and junk."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.runtime import cut

#: At most this many labelled documents, the first by hash of their id, train the rules.
MOST_LABELS = 20_000
#: At most this many frequent words become part of the plan; more are joined to the words of the documents.
MOST_WORDS = 5_000

_BULLET = r"^\s*(?:[-*•–—·+>▪◦]|\d{1,3}[.)]|\[[ xX]?\]|[a-zA-Z][.)])\s"


#: The statistics that rules may use: few, so that few labels suffice.
RULE_FEATURES = (
    "running_words", "odd_ratio", "distinct_parts", "markup_ratio", "n_lines", "words_per_line",
    "marked_lines", "field_lines", "bare_lines", "punctuated_lines", "letter_ratio",
)


def pieces(text: Column) -> dict[str, Column]:
    """What several statistics share: words, lines, sentence parts, and the number of characters that are no white space."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*)"), F.lit(1))
    parts = F.filter(F.split(text, r"[.!?。！？\n\r]+"), lambda s: s.rlike(r"\S"))
    return {
        "words": words,
        "lines": F.filter(F.split(text, r"\r\n|[\n\r\u2028]"), lambda s: s.rlike(r"\S")),
        "parts": F.transform(parts, lambda s: F.trim(s)),
        "tight": F.length(F.regexp_replace(text, r"\s+", "")).cast("double"),
    }


def statistics(text: Column, words: Column, frequent: Column, lines: Column, parts: Column, tight: Column) -> dict[str, Column]:
    """The statistics of a text by name; each is 0 where its denominator is.

    Words are runs of letters, digits and inner apostrophes or hyphens; lines
    are those that are not blank. All are built-in expressions.
    """
    one = F.lit(1.0)
    n = F.size(words).cast("double")
    nl = F.size(lines).cast("double")

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def of_lines(test) -> Column:
        return share(F.size(F.filter(lines, test)).cast("double"), nl)

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    def chars(kinds: str) -> Column:
        # What removing runs of a class takes away; Java is slow at negated unions of ranges.
        return (F.length(text) - F.length(F.regexp_replace(text, f"[{kinds}]+", ""))).cast("double")

    def beyond_ascii(kinds: str) -> Column:
        """As ``chars``, of kinds that a text of bytes below 128 has none of."""
        return F.when(F.octet_length(text) == F.length(text), F.lit(0.0)).otherwise(chars(kinds))

    letters = F.when(F.octet_length(text) == F.length(text), chars("a-zA-Z")).otherwise(chars(r"\p{L}"))
    latin = chars(r"\p{IsLatin}")
    cjk = share(beyond_ascii(r"\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7AF"), tight)
    fields = r"\S\s*[|;\t].*[|;\t]|\S {2,}\S.* {2,}\S|^ {4,}\S.* {3,}\S|,\S[^,]*,|,,|<td|\|.*\||^\s*[+|][-=+|]{3,}|;.*;"

    def hint(s: Column) -> Column:
        """Without one of these no line has fields; a search for a text is far cheaper than the pattern."""
        marks = [s.contains(m) for m in ("|", ";", "\t", "  ", "<td", "+")]
        return reduce(lambda a, b: a | b, marks) | (s.contains(",") & s.rlike(r",\S"))

    return {
        "n_chars": F.length(text).cast("double"),
        "n_words": n,
        "n_lines": nl,
        "mean_word_length": share(F.length(F.array_join(words, "")).cast("double"), n),
        "longest_word": F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0)).cast("double"),
        "words_per_line": share(n, nl),
        "symbol_ratio": share(F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", "")).cast("double"), tight),
        "digit_ratio": share(chars(r"\p{N}"), tight),
        "letter_ratio": share(letters, tight),
        "capital_ratio": share(chars(r"\p{Lu}"), letters),
        "vowel_ratio": share((F.length(text) - F.length(F.translate(text, "aeiouyàáâäãåæèéêëìíîïòóôöõøœùúûüAEIOUYÀÁÂÄÃÅÆÈÉÊËÌÍÎÏÒÓÔÖÕØŒÙÚÛÜ", ""))).cast("double"), F.greatest(latin, one)),
        "latin_ratio": share(latin, F.greatest(letters, one)),
        "cjk_ratio": cjk,
        "odd_ratio": share(beyond_ascii(r"�▀-◿ÂÃ\u0080-\u009F"), tight),
        "markup_ratio": share(F.length(text) - F.length(F.regexp_replace(text, r"<[^<>]{1,200}>|&[a-z#0-9]{2,8};", "")), F.length(text).cast("double")),
        "code_ratio": share(chars(r"{}\[\]<>=\\/|~^_`"), tight),
        "punctuated_lines": of_lines(lambda s: s.rlike(r"[.!?…。！？]['\")”»\s]*$")),
        "marked_lines": of_lines(lambda s: s.rlike(_BULLET)),
        "field_lines": of_lines(lambda s: hint(s) & s.rlike(fields)),
        "short_lines": of_lines(lambda s: F.length(F.trim(s)) <= 45),
        "bare_lines": of_lines(lambda s: (F.length(F.trim(s)) <= 60) & ~s.rlike(r"[.!?…。！？:]['\")”»\s]*$")),
        "sentence_rate": share(count(r"[\p{L}\p{N}][\"”»)]*[.!?。！？]+(?:\s|$|(?=[㐀-鿿]))"), F.greatest(n, one)),
        "common_words": share(F.size(frequent).cast("double"), n),
        "running_words": F.greatest(share(F.length(F.array_join(frequent, "")).cast("double"), F.length(F.array_join(words, "")).cast("double")), cjk),
        "distinct_words": share(F.size(F.array_distinct(words)).cast("double"), n),
        "distinct_parts": share(F.size(F.array_distinct(parts)).cast("double"), F.size(parts).cast("double")),
        "number_words": share(F.size(F.filter(words, lambda w: w.rlike(r"\p{N}"))).cast("double"), n),
    }


def with_statistics(df: DataFrame, text: str, common_words: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` with a struct column ``stats`` of all statistics or those of ``only``; null for null, empty and blank texts. A column of that name is replaced."""
    listed = common_words.where("word is not null").select(F.lower("word").alias("word")).distinct()
    common = sorted(r["word"] for r in listed.limit(MOST_WORDS + 1).collect())
    keep = [c for c in df.columns if c != "stats"]
    has = F.col(text).rlike(r"[^\s\p{Z}\u200B\uFEFF]")
    # Arrays first and statistics second, so that each array is made once.
    made = [F.when(has, c).alias(f"_{k}") for k, c in pieces(F.col(text)).items()]
    staged = df.select(*keep, *made)
    if len(common) <= MOST_WORDS:
        staged = staged.withColumn("_frequent", F.filter("_words", lambda w: w.isin(common or [""])))
    else:
        staged = cut(staged.withColumn("_row", F.monotonically_increasing_id()))
        words = staged.select("_row", F.explode("_words").alias("word")).groupBy("_row", "word").agg(F.count(F.lit(1)).alias("n"))
        found = words.join(listed, "word").groupBy("_row").agg(F.flatten(F.collect_list(F.expr("array_repeat(word, cast(n as int))"))).alias("_frequent"))
        staged = staged.join(found, "_row", "left").withColumn("_frequent", F.coalesce("_frequent", F.when(F.col("_words").isNotNull(), F.array().cast("array<string>"))))
    stats = statistics(F.col(text), *[F.col(f"_{k}") for k in ("words", "frequent", "lines", "parts", "tight")])
    # A row number, which no filter may pass: a filter on what follows would else be moved here and compute it all again.
    once = F.col("_words").isNotNull() & (F.monotonically_increasing_id() >= 0)
    return staged.select(*keep, F.when(once, F.struct(*[c.alias(k) for k, c in stats.items() if only is None or k in only])).alias("stats"))


@dataclass(frozen=True)
class Rule:
    """All ``conditions`` (feature, <= or >, threshold) together mean ``kind``."""

    kind: str
    conditions: tuple[tuple[str, str, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for f, op, t in self.conditions:
            out &= x[f] <= t if op == "<=" else x[f] > t
        return out


def _gain(p0: int, n0: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FOIL's information gain of narrowing p0 of p0+n0 to p of p+n."""
    before = np.log2(p0 / (p0 + n0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - before), -np.inf)


def _grow(x: dict[str, np.ndarray], pos: np.ndarray, use: np.ndarray, kind: str, longest: int) -> Rule:
    conditions: list[tuple[str, str, float]] = []
    live = use.copy()
    while len(conditions) < longest:
        p0, n0 = int((pos & live).sum()), int((~pos & live).sum())
        if p0 == 0 or n0 == 0:
            break
        best = (1e-9, None)
        for f, v in x.items():
            vals, mine = v[live], pos[live]
            order = np.argsort(vals, kind="stable")
            vals, mine = vals[order], mine[order]
            edge = np.flatnonzero(vals[1:] > vals[:-1])
            if not len(edge):
                continue
            cp, ca = np.cumsum(mine)[edge], edge + 1
            for op, p, n in (("<=", cp, ca - cp), (">", p0 - cp, (len(vals) - ca) - (p0 - cp))):
                g = _gain(p0, n0, p.astype(float), n.astype(float))
                i = int(np.argmax(g))
                if g[i] > best[0]:
                    best = (g[i], (f, op, float((vals[edge[i]] + vals[edge[i] + 1]) / 2)))
        if best[1] is None:
            break
        f, op, t = best[1]
        conditions.append(best[1])
        live &= x[f] <= t if op == "<=" else x[f] > t
    return Rule(kind, tuple(conditions))


def _prune(rule: Rule, x: dict[str, np.ndarray], pos: np.ndarray, use: np.ndarray) -> tuple[Rule, float]:
    """The rule cut after the condition at which (p - n) / (p + n) over ``use`` is best, and its precision there."""
    best, kept, precision = -2.0, rule, 0.0
    for k in range(1, len(rule.conditions) + 1):
        r = Rule(rule.kind, rule.conditions[:k])
        hit = r.covers(x) & use
        p, n = int((hit & pos).sum()), int((hit & ~pos).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best + 1e-12:
            best, kept, precision = worth, r, p / (p + n) if p + n else 0.0
    return kept, precision


def learn_rules(
    x: dict[str, np.ndarray], y: np.ndarray, default: str, seed: int = 3, most: int = 24, longest: int = 6, tries: int = 4
) -> list[Rule]:
    """Ordered rules by incremental reduced-error pruning, the rarest kind first; ``default`` needs none.

    For each kind, rules are grown on two thirds of what is left and pruned on
    the other third; several splits are tried and the rule with the best
    coverage at good precision stays. A kind ends when its next rule is right
    in no more than two of three cases or explains fewer than two documents.
    """
    rng = np.random.default_rng(seed)
    kinds, counts = np.unique(y, return_counts=True)
    order = [k for k in kinds[np.argsort(counts, kind="stable")] if k != default]
    left = np.ones(len(y), dtype=bool)
    rules: list[Rule] = []
    for kind in order:
        pos = y == kind
        for _ in range(most):
            if (pos & left).sum() < 2:
                break
            best: tuple[float, Rule | None] = (0.0, None)
            for _ in range(tries):
                part = rng.random(len(y)) < 2 / 3
                grow, prune = left & part, left & ~part
                if not (pos & grow).any():
                    continue
                rule = _grow(x, pos, grow, kind, longest)
                if not rule.conditions:
                    continue
                if (pos & prune).any():
                    rule, _p = _prune(rule, x, pos, prune)
                hit = rule.covers(x) & left
                p, n = int((hit & pos).sum()), int((hit & ~pos).sum())
                held = rule.covers(x) & prune
                hp, hn = int((held & pos).sum()), int((held & ~pos).sum())
                right = p / (p + n) if p + n else 0.0
                if p >= 2 and right > 2 / 3 and (hp + hn == 0 or hp / (hp + hn) > 0.5):
                    score = (p - 3 * n) + right
                    if best[1] is None or score > best[0]:
                        best = (score, rule)
            if best[1] is None:
                break
            rules.append(best[1])
            left &= ~best[1].covers(x)
    return rules


def to_sql(rules: list[Rule], default: str, prefix: str = "stats.") -> str:
    """One CASE expression that applies the rules in order."""
    if not rules:
        return f"'{default}'"
    when = " ".join(
        f"when {' and '.join(f'{prefix}{f} {op} {t!r}D' for f, op, t in r.conditions)} then '{r.kind}'" for r in rules
    )
    return f"case {when} else '{default}' end"


def learn_kinds(docs: DataFrame, key: str, text: str, common_words: DataFrame, labels: DataFrame, kind: str = "kind", default: str = "prose") -> list[Rule]:
    """Rules for the kinds of ``labels`` (key, kind), learned from the statistics of the labelled ``docs``.

    At most ``MOST_LABELS`` labelled documents are measured and collected, a
    documented bound; they are sorted so that the result does not depend on
    their order. Null kinds and ids are ignored, of several labels of a
    document one counts; without labels there are no rules.
    """
    some = labels.where(F.col(kind).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(kind).alias("_kind"))
    some = some.orderBy(F.xxhash64(key), key).limit(MOST_LABELS)
    few = docs.select(key, text).join(F.broadcast(some), key)
    few = with_statistics(few, text, common_words, RULE_FEATURES).where("stats is not null")
    rows = sorted(tuple(r) for r in few.select(*[f"stats.{f}" for f in RULE_FEATURES], "_kind").collect())
    if not rows:
        return []
    x = {f: np.array([r[i] for r in rows], dtype=float) for i, f in enumerate(RULE_FEATURES)}
    return learn_rules(x, np.array([r[-1] for r in rows]), default)


def with_kind(docs: DataFrame, rules: list[Rule], default: str = "prose") -> DataFrame:
    """``docs`` (with ``stats``) and the column ``kind``; null where there are no statistics."""
    # Inside the lambda the statistics are values; named outside, the optimiser would write each out again for each rule.
    kind = F.get(F.transform(F.array("stats"), lambda s: _case(s, rules, default)), 0)
    return docs.withColumn("kind", F.when(F.col("stats").isNotNull(), kind))


def _case(s: Column, rules: list[Rule], default: str) -> Column:
    out = None
    for r in rules:
        test = None
        for f, op, t in r.conditions:
            c = s[f] <= t if op == "<=" else s[f] > t
            test = c if test is None else test & c
        out = F.when(test, r.kind) if out is None else out.when(test, r.kind)
    return F.lit(default) if out is None else out.otherwise(default)
