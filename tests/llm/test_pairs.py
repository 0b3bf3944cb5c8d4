import random
import re

import pytest

from keepsake.llm import pairs

WORDS = {
    "en": "the a of and to in is it was on we that with had for".split(),
    "de": "der die das und ist in den zu mit wir hat nicht ein".split(),
    "fr": "le la les et est de du que nous une dans pas".split(),
    "es": "el la los y es de que una en por con para".split(),
}


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(k, w) for k, v in WORDS.items() for w in v] + [(None, "x"), ("en", None)], "lang string, word string")


Q = "Where did we go in May with the dog?"


@pytest.mark.parametrize("a", [None, "", " \t", "​", "--", "N/A", "(no answer)", "[empty]", "null", "Answer:", "<answer>", "TBD", "{}", '""', "..."])
def test_empty(a):
    assert pairs.is_empty(a)


@pytest.mark.parametrize("a", ["No", "0", "None of them do", "Unknown man", "👍", "9 s", "Missing map"])
def test_not_empty(a):
    assert not pairs.is_empty(a)


@pytest.mark.parametrize("a", [Q, Q.upper(), f"{Q} {Q}", f'"{Q}"', f"Q: {Q}\nA: ", f"You asked: {Q}", Q[:-1] + " ->", Q.replace("the ", ""), Q.replace("dog", "dgo")])
def test_copied(a):
    assert pairs.is_copied(Q, a)


@pytest.mark.parametrize("a", [f"{Q} To Rome", f"{Q} The answer is Rome.", "We went in May", "The dog", ""])
def test_not_copied(a):
    assert not pairs.is_copied(Q, a)


@pytest.mark.parametrize(
    "a",
    ["I'm sorry, but I can't help with that request.", "I’m sorry, but I must decline.", "No comment.", "[declined to answer]", "As an assistant I would rather not answer that.",
     "My policy does not let me look at such emails.", "Leider kann ich diese Frage nicht beantworten.", "Je suis désolé, mais je ne peux pas répondre.", "Lo siento, pero no puedo responder.",
     "Answering would mean revealing private data, which is not permitted."],
)
def test_refusal(a):
    assert pairs.is_refusal(a)


@pytest.mark.parametrize(
    "a", ["They wrote that they were sorry and could not host the eye test.", "The shop replied that it was unable to refund it.", "No, dogs cannot be admitted to the barn.", 'It said "I cannot help you".', "We could not find it"]
)
def test_no_refusal(a):
    assert not pairs.is_refusal(a)


def test_defects_of_a_table(spark, rows, words):
    """Truncation by neighbours needs the whole table."""
    ends = ["the lake", "Rome", "a green hill", "the old harbour", "Paris"]
    rng = random.Random(1)
    data = []
    for i in range(300):
        data.append((i, Q, f"In May we walked the dog to {rng.choice(ends)} and had a picnic."))
    cut = ["In May we walked the dog to", "In May we walked the dog to the lake and had a pic", "In May we walked the dog to Rome and", 'He said "the', "- eggs\n- milk\n-", "In May we walked the dog to the…", "In May we walked the dog"]
    sound = ["In May we walked the dog to Paris and had a picnic", "Rome", "Yes", "- eggs\n- milk", "12 June 2023", "Rome - see photo", "To Rome :)"]
    other = ["Wir haben den Hund mit zu der Oma", "Nous avons mangé dans le jardin et la maison.", "それは五月で、海から帰ってきた直後でした。"]
    data += [(1000 + i, Q, a) for i, a in enumerate(cut)] + [(2000 + i, Q, a) for i, a in enumerate(sound)] + [(3000 + i, Q, a) for i, a in enumerate(other)]
    data += [(4000, Q, None), (4001, Q, Q), (4002, None, None), (4003, None, "I cannot answer this question."), (4004, Q, "x" * 300_000), (None, Q, "")]
    data += [(5000, Q, ""), (5000, Q, "")]
    df = spark.createDataFrame(data, "n bigint, q string, a string").withColumnRenamed("n", "defect")
    got = rows(pairs.broken_pairs(df, "defect", "q", "a", words))
    want = [(1000 + i, "truncated") for i in range(len(cut))] + [(3000 + i, "wrong_language") for i in range(len(other))]
    want += [(4000, "empty"), (4001, "copied"), (4002, "empty"), (4003, "refusal"), (None, "empty"), (5000, "empty"), (5000, "empty")]
    assert got == sorted(want, key=repr)


def test_a_lexicon_too_large_to_travel(spark, rows, words, monkeypatch):
    """The join gives what the words in memory give."""
    data = [(1, Q, "Wir haben den Hund mit zu der Oma"), (2, Q, "We had the dog with us"), (3, Q, "それは五月で、海から帰ってきた直後でした。"), (4, None, "la la la"), (4, Q, None), (5, Q, 'She said "wir haben nicht den Hund" to us'), (6, "Wo ist der Hund?", "Der Hund ist in den Bergen."), (7, "Wo ist der Hund und die Oma?", "It is in the lake and on the hill of that")]
    df = spark.createDataFrame(data, "n bigint, q string, a string")
    want = rows(pairs.judged_pairs(df, "n", "q", "a", words))
    assert [r for r in want if r[1] == "wrong_language"] == [(i, "wrong_language", None) for i in (1, 3, 7)]
    monkeypatch.setattr(pairs, "MOST_WORDS", 5)
    assert rows(pairs.judged_pairs(df, "n", "q", "a", words)) == want


def test_empty_table(spark, rows, words):
    assert rows(pairs.broken_pairs(spark.createDataFrame([], "n bigint, q string, a string"), "n", "q", "a", words)) == []


def test_continuations_against_all_pairs(spark, rows):
    """Any continuation counts, not only the next string, also across partitions."""
    rng = random.Random(2)
    make = lambda n: sorted({"".join(rng.choice("abé N-") for _ in range(rng.randrange(1, 7))) for _ in range(n)})
    known, asked = make(900), make(200)
    known += ["a" * n for n in range(1, 300)]
    asked += ["a" * n for n in range(1, 310, 7)]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs + [None]], "s string")
    got = rows(pairs.continuations(frame(known), frame(asked), r" ?[a-zé]"))
    goes_on = lambda a: any(k.startswith(a) and re.match(r" ?[a-zé]", k[len(a) :]) for k in known)
    assert got == sorted(((a,) for a in set(asked) if goes_on(a)), key=repr)
    assert rows(pairs.continuations(frame([]), frame(asked), "x")) == rows(pairs.continuations(frame(known), frame([]), "x")) == []


def test_what_shows_that_an_answer_is_cut(spark, words):
    """A later string may be the one that goes on; words that nothing ends with are learned from the texts."""
    whole = [f"We saw the lake near R{i} and the hut" for i in range(200)] + [f"I like hut {i} more." for i in range(10)]
    data = [(i, Q, a) for i, a in enumerate(whole)]
    data += [(800 + i, Q, f"The hut {i} was warm.") for i in range(9)]
    data += [(900, Q, "Grandma sang to us"), (901, Q, "Grandma sang to us-all"), (902, Q, "Grandma sang to us 3 times"), (903, Q, "Grandma sang to us Y"), (904, Q, "Grandma sang to us on Sunday.")]
    data += [(910, Q, "At noon she went near"), (911, Q, "At noon I took a long " + "z" * 300), (912, Q, "I took a long " + "z" * 300 + "y nap.")]
    out = {r.key: r.signal for r in pairs.judged_pairs(spark.createDataFrame(data, "n bigint, q string, a string"), "n", "q", "a", words).collect()}
    assert (out[900], out[910], out[911], out[904]) == ("continued", "never_last", "cut_word", None)
    assert not any(out[i] for i in range(len(whole)))


def test_length_spikes(spark, rows):
    lengths = [(40,)] * 50 + [(n,) for n in range(20, 60) for _ in range(3)]
    assert rows(pairs.length_spikes(spark.createDataFrame(lengths, "len int"))) == [(40,)]
