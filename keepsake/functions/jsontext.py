"""JSON inside text: finding balanced values, payloads of memories, critics and judges, text of HTML."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)
_BRACES = re.compile(r"[{}]")


def balanced(text: str | None, start: int, aware: bool = True) -> str | None:
    """The balanced {...} or [...] that begins at ``start``; brackets inside strings don't count if ``aware``."""
    if text is None or not 0 <= start < len(text) or text[start] not in "{[":
        return None
    opening = text[start]
    closing = "}" if opening == "{" else "]"
    depth = 0
    for m in (_MARKS if aware else _BRACES).finditer(text, start):
        if m[0] == opening:
            depth += 1
        elif m[0] == closing:
            depth -= 1
            if not depth:
                return text[start : m.end()]
    return None


def first_object(text: str | None, aware: bool = True) -> str | None:
    return None if text is None else balanced(text, text.find("{"), aware)


def _loads(text: str):
    try:
        return json.loads(text)
    except (json.JSONDecodeError, RecursionError):
        return None


def without_fences(text: str) -> str:
    """``text`` without the lines of a code fence around it."""
    m = re.fullmatch(r"```[^\n]*\n(.*?)(?:\n```[^\n]*)?", text.strip(), re.S)
    return m[1].strip() if m else text.strip()


def memory_entries(text: str | None) -> list[str] | None:
    """The entries of a memory payload, one JSON text each; null where there is no payload.

    Fenced blocks, then the first balanced array, then the whole text are tried
    as an array or an object that wraps one; else single objects with a
    restatement are salvaged.
    """
    if text is None:
        return None
    tries = re.findall(r"```(?:json)?\s*(.*?)\s*```", text, re.I | re.S) + [balanced(text, text.find("[")) or "", text]
    for t in tries:
        data = _loads(t.strip()) if t.strip() else None
        if isinstance(data, dict):
            data = next((data[k] for k in ("memory_entries", "memories", "entries", "data", "results") if isinstance(data.get(k), list)), None)
        if isinstance(data, list):
            return [json.dumps(x, ensure_ascii=False) for x in data]
    found = [balanced(text, m.start()) for m in re.finditer(r"\{", text)]
    kept = [x for x in found if x and isinstance(d := _loads(x), dict) and "lossless_restatement" in d]
    return kept or None


def json_blob(text: str | None) -> str | None:
    """The JSON object that a text is or holds first, fences ignored; null where there is none."""
    if not text or not text.strip():
        return None
    plain = without_fences(text)
    for t in (plain, first_object(plain) or ""):
        if isinstance(_loads(t), dict):
            return t
    return None


def critic_fields(text: str | None) -> tuple[str | None, str | None, int | None]:
    """(final answer, support, utility 1-5) of a critic's reply."""
    plain = without_fences(text or "")
    data = _loads(plain)
    if not isinstance(data, dict):
        data = _loads(first_object(plain, aware=False) or "")
    data = data if isinstance(data, dict) else {}
    final = data.get("final_answer") or data.get("answer")
    final = ", ".join(map(str, final)) if isinstance(final, list) else None if final is None else str(final).strip()
    said = str(data.get("support") or data.get("grounding") or "").strip().lower()
    support = None
    for value, marks in (("fully", ("fully",)), ("partially", ("partial",)), ("none", ("none", "no support", "contradict"))):
        if support is None and any(m in said for m in marks):
            support = value
    support = support or {"full": "fully", "complete": "fully", "part": "partially", "no": "none"}.get(said)
    try:
        utility = None if data.get("utility") is None else max(1, min(5, int(float(data["utility"]))))
    except (TypeError, ValueError, OverflowError):
        utility = None
    return final, support, utility


# Tags whose content is no text, and the most characters that are kept.
_SILENT = {"script", "style", "noscript", "template"}
HTML_LIMIT = 50_000


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in _SILENT

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in _SILENT))

    def handle_data(self, data):
        if not self.silent and data.strip():
            self.parts.append(data.strip())


def html_text(html: str | None, limit: int = HTML_LIMIT) -> str | None:
    """The text of HTML in single blanks, without scripts, styles, images and comments; longer ones end in '...'."""
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    text = re.sub(r"\s+", " ", " ".join(p.parts)).strip()
    return text if len(text) <= limit else text[:limit] + "..."


_LABEL = re.compile(r"^\s*(from|to|subject|date|sent|cc)\s*:?\s*$", re.I)


class _Cells(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[str] = []
        self.title = ""
        self.tag = ""

    def handle_starttag(self, tag, attrs):
        self.tag = tag
        if tag in ("td", "th", "b", "strong", "span", "p", "div"):
            self.cells.append("")

    def handle_endtag(self, tag):
        if tag in ("b", "strong", "td", "th"):
            self.cells.append("")

    def handle_data(self, data):
        if self.tag == "title":
            self.title += data
        elif self.cells:
            self.cells[-1] += data
        else:
            self.cells.append(data)


def html_headers(html: str | None) -> dict[str, str]:
    """subject, sender, date and recipient of a mail in HTML: bold labels, header tables, the title, then the text."""
    if not html:
        return {}
    p = _Cells()
    p.feed(html)
    cells = [c.strip() for c in p.cells if c.strip()]
    out: dict[str, str] = {}
    names = {"from": "sender", "to": "recipient", "subject": "subject", "date": "date", "sent": "date", "cc": "cc"}
    for a, b in zip(cells, cells[1:]):
        if m := _LABEL.match(a):
            out.setdefault(names[m[1].lower()], b.lstrip(": ").strip())
    if "subject" not in out and p.title.strip():
        out["subject"] = p.title.strip()
    text = "\n".join(cells)
    for label, name in names.items():
        if m := re.search(rf"(?im)^{label}\s*:\s*(.+)$", text):
            out.setdefault(name, m[1].strip())
    return out


def scalar(function, kind: str = "string"):
    """A column function that applies a Python function of one text to Arrow batches of it."""
    types = {"string": StringType(), "array<string>": ArrayType(StringType())}

    def apply(c: Column) -> Column:
        @F.pandas_udf(types[kind])
        def run(s: pd.Series) -> pd.Series:
            return pd.Series([function(x if isinstance(x, str) else None) for x in s], dtype=object)

        return run(c)

    return apply


first_json_object = scalar(first_object)
json_object_of = scalar(json_blob)
memory_payload = scalar(memory_entries, "array<string>")
text_of_html = scalar(html_text)


def critic(c: Column) -> Column:
    """struct(final_answer, support, utility)."""

    @F.pandas_udf("final_answer string, support string, utility int")
    def run(s: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([critic_fields(x) for x in s], columns=["final_answer", "support", "utility"])
        return out.astype({"utility": "Int32"})

    return run(c)


def headers_of_html(c: Column) -> Column:
    """map of header names to values."""

    @F.pandas_udf("array<struct<k:string,v:string>>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[{"k": k, "v": v} for k, v in html_headers(x).items()] for x in s])

    return F.map_from_entries(run(c))


def critic_answer(answer: Column, critic_struct: Column) -> Column:
    """Unknown where the critic finds no support, else its final answer if it has one, else the answer."""
    final = critic_struct["final_answer"]
    return F.when(critic_struct["support"] == "none", "Unknown").otherwise(F.coalesce(F.when(final != "", final), answer))


def judge_verdict(raw: Column, literal: bool = True) -> Column:
    """struct(accuracy, explanation, fallback) of a judge's reply.

    The outermost braces are read as JSON with an accuracy; else words decide.
    ``literal`` keeps the word rule as it is, by which "incorrect" holds
    "correct" and so counts as right; otherwise negations are seen first.
    """
    low = F.lower(raw)
    blob = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    v = F.try_parse_json(blob)
    acc = F.try_variant_get(v, "$.accuracy", "string")
    words = F.when(low.contains('"accuracy": true') | low.contains('"accuracy":true'), True).when(low.contains('"accuracy": false') | low.contains('"accuracy":false'), False)
    if not literal:
        words = words.when(low.rlike(r"\b(incorrect|inaccurate|not (correct|accurate)|wrong|false)\b"), False)
    words = words.when(low.rlike("accurate|correct|matches|true|yes"), True).otherwise(False)
    number = acc.try_cast("double")
    parsed = F.when(F.lower(acc) == "true", 1.0).when(F.lower(acc) == "false", 0.0).otherwise(number)
    told = F.when(F.length(raw) < 500, raw).otherwise(F.concat(F.substring(raw, 1, 500), F.lit("...")))
    has = acc.isNotNull()
    return F.struct(
        F.when(has, parsed).otherwise(words.cast("double")).alias("accuracy"), F.when(has, F.try_variant_get(v, "$.explanation", "string")).otherwise(told).alias("explanation"), (~has).alias("fallback")
    )
