"""Defects of question and answer pairs: empty, copied, refused, truncated or in another language."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from keepsake.runtime import cut

#: A common_words table of up to this many rows travels with every task; a larger one is joined to the words of the texts.
MOST_WORDS = 100_000

# What stands for no answer, folded, without brackets and outer punctuation.
_PLACE = {
    "n/a", "na", "n.a", "n. a", "none", "null", "nil", "nan", "undefined", "empty", "blank", "missing", "unknown", "answer", "response", "tbd", "tba", "tbc",
    "todo", "to do", "fixme", "xxx", "xx", "x", "placeholder", "no answer", "no response", "not available", "not applicable", "to be determined", "to be done", "to be added", "to be filled",
    "answer here", "your answer", "your answer here", "insert answer", "insert answer here", "enter answer here", "lorem ipsum", "no data", "pending", "text", "string",
    "antwort", "réponse", "respuesta", "keine antwort", "k.a", "k. a", "entfällt", "sans réponse", "pas de réponse", "aucune réponse", "sin respuesta", "sin datos", "a", "r", "sin contestar", "ohne antwort",
}

# Words around a question that is merely given back.
ECHO_WORDS = set(
    "q a r question answer response frage antwort réponse pregunta respuesta you asked ask your the was is asks original user prompt repeat here reads reply"
    " sie fragten du hast gefragt vous avez demandé usted preguntó me preguntaste die deine ihre la votre su tu lautet".split()
)

# How an answerer declines, by language (case is ignored).
REFUSALS = [
    r"\bi(?:'m| am)?(?: really| very| so| truly)? (?:sorry|afraid|apologi[sz]e)\b.{0,60}\b(?:can(?:no|')t|cannot|unable|not able|must decline|have to decline|won't|will not|not allowed|don't|do not|not permitted|not comfortable)",
    r"\b(?:sorry|apologies|regrettably|unfortunately),?\b.{0,20}\b(?:i|we|this (?:system|assistant|model))\b.{0,20}\b(?:can(?:no|')t|cannot|am unable|am not able|must decline|have to decline|won't|will not|would rather not|do not|don't|am not allowed|may not)",
    r"^(?:sorry|apologies|regrettably|unfortunately)?[,.]?\s*(?:but )?i (?:can(?:no|')t|cannot|am unable|'m unable|am not able|'m not able|must decline|have to decline|won't|will not|would rather not|would prefer not|prefer not|refuse|decline|am not allowed|'m not allowed|am not permitted|don't feel comfortable|do not feel comfortable|am not comfortable|'m not comfortable|may not)\b",
    r"\bi (?:don't|do not) feel comfortable\b|\bi(?:'d| would) (?:rather|prefer) not (?:to )?(?:answer|say|discuss|share|comment|respond)",
    r"\bas an? (?:ai|artificial|assistant|language model|virtual|digital|automated)\b.{0,40}\b(?:i|can|not|unable|decline)",
    r"\bi (?:must|have to|need to|am going to|will) (?:respectfully |politely )?(?:decline|refuse|pass)\b",
    r"\bi (?:can(?:no|')t|cannot|could not|am unable to|am not able to|'m unable to|'m not able to|won't|will not) (?:help|assist|answer|respond|provide|share|disclose|discuss|comment|comply|give|reveal|say|tell|look|access|do that|fulfil|support|offer|view|see|open|read|determine|identify|continue|process|complete|talk)",
    r"\b(?:my|our) (?:policy|policies|guidelines|rules|instructions|programming)\b.{0,30}\b(?:not|forbid|prohibit|prevent)",
    r"\b(?:this|that|your|the) (?:request|question|prompt|topic)\b.{0,40}\b(?:against|violates?|not (?:permitted|allowed|possible|something)|cannot be (?:answered|fulfilled|processed)|declined|outside)",
    r"\b(?:which|that) is not (?:permitted|allowed)\b|\bno answer is given\b|\bthis (?:system|assistant|model|bot)\b.{0,12}\b(?:will|can|does|is)\s?(?:not|n't|unable)\b|\b(?:something|one) (?:this system|i|we) (?:will|can)(?:not| not) (?:answer|help|share)",
    r"^\W*(?:declined|refused|no comment|answer withheld|response withheld|withheld|redacted|refusal)\b.{0,30}$|\bdeclined to (?:answer|respond)\W*$|\b(?:not|un)\s?able to (?:answer|help|assist|respond|comply|share|provide|discuss|disclose)\b(?!.*\b(?:wrote|said|replied|reported|told)\b)",
    r"\b(?:es )?tut mir(?: sehr| wirklich)? leid\b.{0,60}\b(?:nicht|kein|ablehnen|leider)|\bich (?:kann|darf|möchte|werde|will)\b.{0,50}\b(?:nicht (?:beantworten|antworten|helfen|weitergeben|teilen|sagen|preisgeben|mitteilen|darüber|dazu|offenlegen|besprechen|geben|nennen|äußern)|keine (?:auskunft|antwort|angaben|information)|ablehnen|verweigern)|\b(?:leider|bedauerlicherweise)\b.{0,20}\b(?:ich|mir)\b.{0,50}\b(?:nicht|ablehnen|keine|unmöglich)\b|\bmuss ich\b.{0,40}\bablehnen|\bals (?:ki|sprachmodell|assistent)|\bdarauf (?:kann|darf|möchte) ich|\bkein kommentar\b|\b(?:diese|ihre) (?:anfrage|frage)\b.{0,40}\b(?:nicht|verstößt|abgelehnt|kann ich)",
    r"\bje (?:suis |m'en )?(?:désolée?|regrette|m'excuse)|\bje (?:ne )?(?:peux|puis|dois|suis|préfère|veux|souhaite|refuse|vais)\b.{0,50}\b(?:pas|refuser|décliner|répondre à cette)|\bje dois (?:refuser|décliner)|\bil m'est impossible|\bpas de commentaire|\bdésolée?,.{0,40}\b(?:peux|puis|dois|impossible|pas)|\ben tant qu'(?:assistant|ia|intelligence|modèle)|\b(?:cette|votre) (?:demande|question)\b.{0,40}\b(?:contraire|ne peut|pas|enfreint)",
    r"\blo siento\b.{0,60}\b(?:no|rechazar|imposible|debo)\b|\b(?:no (?:puedo|puedes|quiero|debo|me es posible|estoy autorizad[oa]|me siento)|debo (?:rechazar|negarme|declinar)|prefiero no|tengo que (?:rechazar|declinar))\b.{0,40}|\bcomo (?:asistente|modelo|ia|inteligencia)\b|\bsin comentarios\b|\blamentablemente\b.{0,20}\bno (?:puedo|me)|\b(?:esta|su|tu) (?:solicitud|pregunta|petición)\b.{0,40}\b(?:no|contra|infringe)",
]
_REFUSAL = [re.compile(p, re.I | re.S) for p in REFUSALS]

# Somebody else speaks, so what follows is a report and no refusal of the answerer.
_REPORT = re.compile(
    r"^(?:no, |yes, )?(?:they|he|she|it|the|our|my|his|her|their|a|an|dad|mum|mom|grandma|grandpa|[A-Z]\w+)\b[^.]{0,60}?\b(?:wrote|said|says|replied|answered|told|reported|mentioned|announced|explained|states?|declined|refused|apologi[sz]ed|was|were)\b"
    r"|\b(?:schrieb|schrieben|sagte|sagten|antwortete|teilte|erklärte|a écrit|ont écrit|a dit|a répondu|escribió|escribieron|dijo|respondió|contestó)\b",
    re.I,
)

# Frequent words of languages that no table gives.
OTHER_WORDS = {
    "it": "il lo la gli le di che è e un una per non con del della nella nel sono si al da dei alla poco dopo nostro ritorno era stato stata vicino questo tre più molto ha hanno vedono giocano anche come ma".split(),
    "pt": "o os as um uma de do da dos das em no na nos nas que e é foi não com para por pouco depois ao à seu sua mais muito estava há são como mas três aparecem brincam lado voltarmos também".split(),
    "nl": "de het een en van ik te dat die in is niet op aan met voor er maar om dan zou of wat mijn was naar bij zijn heeft ons wij ook".split(),
}

# Words with which no sentence or list ends, in en, de, fr and es.
OPEN_WORDS = set(
    "the a an and or of to in on at by for with from as that which who whose because although while when if than its their our my your his into onto over under between near beside during before after about since until is are was were has had been be will would can could should may not only also very most some any each every other another this these those "
    "der die das den dem des ein eine einen einem einer eines und oder von zu im in am an auf aus bei mit nach für vom zum zur dass weil wenn als obwohl neben etwa genau laut seit wird wurde hat haben ist sind war waren sehr unter über zwischen hinter vor "
    "le la les un une des du de d l et ou à au aux en dans sur sous avec pour par que qui parce car près derrière devant chez est sont était ont sans très mais "
    "el los las unos unas una uno y o del al en con por para que porque cerca según desde sobre entre hasta es está son fue ha han sin muy pero su sus mi tu se lo".split()
) - set("since not can ist sind war vor son fue está other another also only those most".split())

_END = re.compile(r"""[.!?…。！？»"”’')\]}:;>*_|~]\s*$|[\U0001F000-\U0001FAFF☀-➿️]\s*$""")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[^\w\s]")
_QUOTED = re.compile(r"\"[^\"\n]{0,400}\"|“[^”\n]{0,400}”|«[^»\n]{0,400}»|„[^“”\n]{0,400}[“”]")


#: An ASCII text that is no longer than the longest placeholder may be with its signs; a longer one is none.
_SHORT_ASCII = re.compile(r"(?:[^a-zA-Z0-9]*[a-zA-Z0-9]){0,40}[^a-zA-Z0-9]*")
_ALNUM = re.compile(r"[a-zA-Z0-9]")


def _fold(s: str) -> str:
    return unicodedata.normalize("NFKC", s).casefold()


def is_empty(answer: str | None) -> bool:
    """Null, blank, without any letter or digit, or a mere placeholder."""
    if answer is None:
        return True
    if answer.isascii() and not _SHORT_ASCII.fullmatch(answer):
        return not _ALNUM.search(answer)
    core = "".join(c for c in _fold(answer) if unicodedata.category(c) not in ("Cf", "Cc", "Zs", "Zl", "Zp") or c == " ").strip()
    if not any(c.isalnum() for c in core):
        # A digit-free run of signs says nothing; pictures (emoji) may be an answer.
        return not any(unicodedata.category(c) == "So" for c in core)
    bare = re.sub(r"^[\W_]+|[\W_]+$", "", re.sub(r"\s+", " ", core))
    return bare in _PLACE


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", _fold(text))


def is_copied(question: str | None, answer: str) -> bool:
    """The answer's words are the question's, once or more, nearly in full, and besides only words of an echo."""
    q, a = _words(question or ""), _words(answer)
    if len(q) < 3 or not a:
        return False
    left = []
    want = {w: q.count(w) for w in q}
    rounds = max(1, round(len(a) / len(q)))
    have: dict[str, int] = {}
    for w in a:
        if have.get(w, 0) < want.get(w, 0) * rounds:
            have[w] = have.get(w, 0) + 1
        else:
            left.append(w)
    covered = sum(min(have.get(w, 0), n) for w, n in want.items()) / len(q)
    if covered < 0.7:
        return False
    missing = [w for w in want if have.get(w, 0) == 0]
    real = [w for w in left if w not in ECHO_WORDS and not any(_near(w, m) for m in missing)]
    return not real


def _near(a: str, b: str) -> bool:
    """At most one letter differs, is missing or is swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def is_refusal(answer: str) -> bool:
    text = answer.replace("’", "'").strip()
    plain = _QUOTED.sub(" ", text)
    if _REPORT.search(plain) and not re.match(r"\W*(?:i|as an|my|this request|that is)\b", plain, re.I):
        return False
    return any(p.search(plain) for p in _REFUSAL)


_LETTERS = re.compile(r"[^\W\d_]+")


def by_word(lexicon: dict[str, frozenset]) -> dict[str, tuple[str, ...]]:
    """The languages of each word."""
    out: dict[str, list[str]] = {}
    for lang, words in lexicon.items():
        for w in words:
            out.setdefault(w, []).append(lang)
    return {w: tuple(langs) for w, langs in out.items()}


def spoken(text: str) -> list[str]:
    """The words of a text in lower case, without what it quotes."""
    return _LETTERS.findall(_QUOTED.sub(" ", text).lower())


def word_scores(text: str, languages: list[str], of: dict[str, tuple[str, ...]]) -> dict[str, int]:
    """Frequent words of each language among the words of ``text``."""
    scores = dict.fromkeys(languages, 0)
    for w in spoken(text):
        for lang in of.get(w, ()):
            scores[lang] += 1
    return scores


def script_scores(text: str) -> dict[str, int]:
    """Other scripts than Latin, by their letters, if most of the letters are of one."""
    text = _QUOTED.sub(" ", text)
    if text.isascii():
        return {}
    letters, scores = [c for c in text if c.isalpha()], {}
    for name, low, high in (("cjk", "぀", "鿿"), ("cyrillic", "Ѐ", "ӿ"), ("greek", "Ͱ", "Ͽ"), ("arabic", "؀", "ۿ"), ("hangul", "가", "힯")):
        n = sum(low <= c <= high for c in letters)
        if n >= 4 and n * 2 > len(letters):
            scores[name] = max(3, n // 2)
    return scores


def is_wrong_language(q: dict[str, int], a: dict[str, int]) -> bool:
    """By the scores of question and answer, running words of the answer are of another language."""
    own = max(q, key=q.get)
    if q[own] < 1:
        return False
    best = max(a, key=a.get)
    mine = a.get(own, 0)
    return best != own and a[best] >= 2 and a[best] >= mine + 2 and a[best] >= 1.5 * mine


def unended(text: str) -> str:
    """``text`` without outer blanks and a closing ellipsis, which ends no sentence."""
    return re.sub(r"\s*(?:…|\.\.\.)$", "", text.strip())


def masked(text: str) -> str:
    """``text`` with numbers and capitalised words after the first replaced, so one phrase has one form."""
    t = re.sub(r"\d+", "0", text.rstrip())
    return re.sub(r"(?<=\S\s)[A-ZÀ-Þ][\w-]*", "N", t)


def tail(text: str) -> tuple[str, str]:
    """The last two tokens, numbers as 0."""
    toks = ["0" if t.isdigit() else t for t in _TOKEN.findall(text)[-2:]]
    return (toks[-2] if len(toks) > 1 else "", toks[-1] if toks else "")


def is_open(text: str) -> bool:
    """The text ends where no sentence or list can: unclosed quote or bracket, comma, bare bullet or function word."""
    t = text
    words = t.split()
    if len(words) < 3:
        return False
    if re.search(r"(?:[,;(\[{–—&+/]|\s-)$", t) or re.search(r"\n\s*(?:[-*•]|\d+[.)])$", t):
        return True
    if _END.search(t):
        return False
    if t.count('"') % 2 or t.count("(") > t.count(")") or t.count("“") > t.count("”") or t.count("«") > t.count("»"):
        return True
    last = re.findall(r"[^\W\d_]+", t)
    return bool(last) and t.endswith(last[-1]) and last[-1] in OPEN_WORDS and len(words) >= 4


_VERDICT = "defect string, open boolean, mask string, ctx string, len int, words int, ended boolean"


def _rules(languages: list[str], of: dict[str, tuple[str, ...]] | None):
    """The rules on a pair; without ``of`` the last two columns give (language, words) of question and answer."""
    counted = lambda text, told: word_scores(text, languages, of) if of is not None else dict.fromkeys(languages, 0) | {x["lang"]: int(x["n"]) for x in (told if told is not None else ())}

    @pandas_udf(_VERDICT)
    def run(question: pd.Series, answer: pd.Series, q_told: pd.Series, a_told: pd.Series) -> pd.DataFrame:
        rows = []
        for q, a, qt, at in zip(question, answer, q_told, a_told):
            if is_empty(a):
                rows.append(("empty", False, None, None, 0, 0, True))
                continue
            if is_copied(q, a):
                verdict = "copied"
            elif is_refusal(a):
                verdict = "refusal"
            elif is_wrong_language(counted(q or "", qt) | script_scores(q or ""), counted(a, at) | script_scores(a)):
                verdict = "wrong_language"
            else:
                verdict = None
            t = unended(a)
            rows.append((verdict, is_open(t), masked(t), "\x00".join(tail(t)), len(t), len(t.split()), bool(_END.search(t))))
        return pd.DataFrame(rows, columns=["defect", "open", "mask", "ctx", "len", "words", "ended"])

    return run


@pandas_udf(ArrayType(StringType()))
def _contexts(texts: pd.Series) -> pd.Series:
    """The distinct pairs (token before, word) of words that the text goes on after."""
    out = []
    for t in texts:
        toks = ["0" if x.isdigit() else x for x in _TOKEN.findall(t)] if t else []
        out.append(sorted({f"{a}\x00{b}" for a, b in zip(["", *toks], toks[:-1]) if b[0].isalpha()}))
    return pd.Series(out)


_PIECE = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|\n|[^\w\s]")
_STOP = frozenset(".!?…,;:)]\n。，")


@pandas_udf(ArrayType(StructType().add("word", StringType()).add("last", BooleanType())))
def _ends(texts: pd.Series) -> pd.Series:
    """The distinct words of a text, by whether a sentence, line, list item or the text ends after them or a word follows."""
    out = []
    for t in texts:
        toks = [*_PIECE.findall(t.strip()), "\n"] if t else []
        seen = {(a.lower(), b in _STOP) for a, b in zip(toks, toks[1:]) if a[0].isalpha() and (b in _STOP or b[0].isalnum())}
        out.append([{"word": w, "last": e} for w, e in sorted(seen)])
    return pd.Series(out)


def continuations(strings: DataFrame, wanted: DataFrame, going_on: str) -> DataFrame:
    """(s): the distinct strings of ``wanted`` that some string of ``strings`` begins with, the rest of which matches ``going_on``.

    Both are one column ``s``. The distinct strings are range-partitioned and
    sorted, so that all that begin with s follow it. A partition is read once,
    with the wanted strings that begin the current one on a stack; each is
    compared with every string that it begins, until one goes on as asked. What
    is still open at the end of a partition begins its last string, so there are
    few; those that also begin the first string of the next are looked for there.
    """
    rest = re.compile(going_on)
    both = strings.select("s", F.lit(True).alias("known"), F.lit(False).alias("asked")).unionByName(wanted.select("s", F.lit(False).alias("known"), F.lit(True).alias("asked")))
    both = both.where("s is not null").groupBy("s").agg(F.max("known").alias("known"), F.max("asked").alias("asked"))
    ordered = cut(both.repartitionByRange("s").sortWithinPartitions("s").withColumn("pid", F.spark_partition_id()))

    def reader(begun: dict[int, list[str]], first: bool):
        def run(frames):
            stack, pid = None, -1
            for f in frames:
                done = []
                for s, known, asked, at in zip(f["s"], f["known"], f["asked"], f["pid"]):
                    if stack is None:
                        pid, stack = int(at), list(begun.get(int(at), []))
                    while stack and not s.startswith(stack[-1]):
                        stack.pop()
                    if not stack and not first:
                        break
                    if known and stack:
                        on = [x for x in stack if len(x) < len(s) and rest.match(s[len(x) :])]
                        if on:
                            done += on
                            stack = [x for x in stack if x not in on]
                    if asked and first:
                        stack.append(s)
                yield pd.DataFrame({"s": pd.Series(done, dtype=object), "pid": -1})
            if first and stack:
                yield pd.DataFrame({"s": pd.Series(stack, dtype=object), "pid": pid})

        return run

    out = cut(ordered.mapInPandas(reader({}, True), "s string, pid int"))
    left = out.where("pid >= 0").collect()  # strings that begin the last one of their partition
    found = out.where("pid < 0").select("s")
    firsts = sorted(map(tuple, ordered.groupBy("pid").agg(F.min("s")).collect())) if left else []  # one per partition
    begun: dict[int, list[str]] = {}
    for s, pid in sorted((r.s, r.pid) for r in left):
        for p, head in firsts:
            if p > pid and head.startswith(s):
                begun.setdefault(p, []).append(s)
    if begun:
        found = found.unionByName(ordered.where(F.col("pid").isin(list(begun))).mapInPandas(reader(begun, False), "s string, pid int").select("s"))
    return found.distinct()


def length_spikes(lengths: DataFrame, least: int = 20, factor: float = 6.0, reach: int = 5) -> DataFrame:
    """Lengths at which far more distinct unended texts stop than at the lengths around: a limit cut them.

    ``lengths``: one row (len) per distinct text. The histogram is aggregated
    before the shuffle; its neighbours are joined, so nothing is collected.
    """
    hist = lengths.groupBy("len").agg(F.count(F.lit(1)).alias("n"))
    around = hist.select(F.explode(F.array(*[F.col("len") + d for d in range(-reach, reach + 1) if d])).alias("len"), F.col("n").alias("m"))
    around = around.groupBy("len").agg((F.sum("m") / F.lit(2.0 * reach)).alias("level"))
    return hist.join(around, "len", "left").where((F.col("n") >= least) & (F.col("n") >= factor * F.coalesce("level", F.lit(0.0)))).select("len")


def lexicon_of(common_words: DataFrame) -> tuple[DataFrame, dict[str, frozenset] | None]:
    """(words by language with those of ``OTHER_WORDS``, the same by language): as a table, and unless it has too many rows in memory."""
    spark = common_words.sparkSession
    own = spark.createDataFrame([(lang, w) for lang, ws in OTHER_WORDS.items() for w in ws], "lang string, word string")
    every = common_words.where("lang is not null and word is not null").select("lang", F.lower("word").alias("word")).unionByName(own).distinct()
    rows = every.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        return every, None
    out: dict[str, set] = {}
    for lang, word in rows:
        out.setdefault(lang, set()).add(word)
    return every, {k: frozenset(v) for k, v in out.items()}


@pandas_udf(ArrayType(StringType()))
def _spoken(texts: pd.Series) -> pd.Series:
    return pd.Series([spoken(t) if t else [] for t in texts])


def _told(rows: DataFrame, every: DataFrame) -> DataFrame:
    """``rows`` (key, q, a) with (lang, n) arrays of question and answer, by joining their words to a large lexicon."""
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    sides = [rows.select("row", F.lit(side).alias("side"), F.explode(_spoken(side)).alias("word")) for side in ("q", "a")]
    words = sides[0].unionByName(sides[1]).groupBy("row", "side", "word").agg(F.count(F.lit(1)).alias("n"))
    found = words.hint("merge").join(every, "word").groupBy("row", "side", "lang").agg(F.sum("n").alias("n"))
    pick = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct("lang", "n")))
    found = found.groupBy("row").agg(pick("q").alias("qt"), pick("a").alias("at"))
    return rows.hint("merge").join(found, "row", "left").drop("row")


#: A word that so many texts go on after, and of which at most such a share end there, is one that cannot be last.
#: Cut answers stop at every word alike, about once in a thousand; sound ones stop at few words, and far more often.
OFTEN, SELDOM = 100, 0.008


def broken_pairs(df: DataFrame, key: str, question: str, answer: str, common_words: DataFrame) -> DataFrame:
    """(key, defect) of each row whose answer is unfit: empty, copied, refusal, wrong_language or truncated.

    See ``judged_pairs``, of whose rows these are those with a defect.
    """
    return judged_pairs(df, key, question, answer, common_words).where("defect is not null").select("key", "defect")


def judged_pairs(df: DataFrame, key: str, question: str, answer: str, common_words: DataFrame) -> DataFrame:
    """(key, defect, signal) of every row: the defect or null, and for truncated answers what showed it.

    A row has at most one defect, the first that holds of empty, copied,
    refusal, wrong_language and truncated. Rules on the pair itself find the
    first four. An answer that no sign ends is truncated, by these signals in
    order: ``continued``, another answer, numbers and names aside, begins with it
    and goes on in mid-sentence; ``cut_word``, its last word is a part of the word
    that others have after the same token (both by comparing neighbours in
    sorted order); ``limit``, it stops at a length at which unnaturally many do;
    ``never_last``, its last word is one that texts often go on after and
    sentences never end with; ``open``, it ends with a comma, a bare bullet, an
    open quote or bracket, or one of the function words of a list. Words,
    answers and lengths are counted over all rows. A null question makes only
    empty, refused and truncated answers recognisable. Rows with a null key are
    kept; extra columns are ignored.
    """
    every, lexicon = lexicon_of(common_words)
    languages = [*OTHER_WORDS, *sorted({*(lexicon if lexicon is not None else [r["lang"] for r in every.select("lang").distinct().collect()])} - set(OTHER_WORDS))]
    rule = _rules(languages, None if lexicon is None else by_word(lexicon))
    rows = df.select(F.col(key).alias("key"), F.col(question).alias("q"), F.col(answer).alias("a"))
    if lexicon is None:
        told = _told(rows, every)
    else:
        none = F.lit(None).cast("array<struct<lang:string,n:bigint>>")
        told = rows.withColumn("qt", none).withColumn("at", none)
    v = cut(told.withColumn("v", rule("q", "a", "qt", "at")).select("key", "v.*"))
    texts = rows.select("q").unionByName(rows.select(F.col("a").alias("q"))).where("q is not null").distinct()
    texts = cut(texts.select(_contexts("q").alias("contexts"), _ends("q").alias("ends")))
    contexts = texts.select(F.explode("contexts").alias("s")).distinct()
    suspects = v.where("defect is null and not ended and words >= 3")
    # Whole answers that others continue.
    masks = v.where("mask is not null").select(F.col("mask").alias("s")).distinct()
    longer = continuations(masks, suspects.where("words >= 4").select(F.col("mask").alias("s")).distinct(), r" ?[^\W\d_A-ZÀ-ÖØ-Þ]")
    longer = longer.select(F.col("s").alias("mask"), F.lit(True).alias("continued"))
    # Last words that are cut short.
    asked = suspects.where(F.col("ctx").rlike("\\x00\\p{L}+$")).select(F.col("ctx").alias("s")).distinct()
    parts = continuations(contexts, asked, r"[^\W\d_]").join(contexts.hint("merge"), "s", "left_anti")
    parts = parts.select(F.col("s").alias("ctx"), F.lit(True).alias("cut_word"))
    # Lengths that a limit made.
    spikes = length_spikes(suspects.where("words >= 6").select("mask", "len").distinct().select("len")).withColumn("spike", F.lit(True))
    # Words that nothing ends with.
    ends = texts.select(F.explode("ends").alias("e")).groupBy("e.word").agg(F.count_if("e.last").alias("last"), F.count_if(~F.col("e.last")).alias("on"))
    ends = ends.where((F.col("on") >= OFTEN) & (F.col("last") <= F.col("on") * SELDOM)).select("word", F.lit(True).alias("never_last"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    signal = (
        F.when(yes("continued") & (F.col("words") >= 4), "continued").when(yes("cut_word"), "cut_word").when(yes("spike") & (F.col("words") >= 6), "limit")
        .when(yes("never_last") & (F.col("words") >= 4), "never_last")
    )
    found = v.withColumn("word", F.lower(F.regexp_extract("ctx", "\\x00(\\p{L}.*)$", 1)))
    found = found.join(longer, "mask", "left").join(parts, "ctx", "left").join(spikes, "len", "left").join(ends, "word", "left")
    found = found.withColumn("signal", F.when(F.col("defect").isNull(), F.coalesce(F.when(~F.col("ended") & (F.col("words") >= 3), signal), F.when(F.col("open"), F.lit("open")))))
    return found.select("key", F.coalesce("defect", F.when(F.col("signal").isNotNull(), F.lit("truncated"))).alias("defect"), "signal")
