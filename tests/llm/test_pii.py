import random
import time

import pytest
from pyspark.sql import functions as F

from keepsake.llm import pii

CONTACTS = [("Briaemund", "Ashagate"), ("Briarec", "Ashefield"), ("Davirik", "Brackavik"), ("Davodra", "Brackagate"), ("Elyaemund", "Crowafield"), ("Elyarec", "Crowavik"), ("Fenodra", "Ashavik"), ("Fenirik", "Brackafield"), (None, " ")]
MODEL = pii.NameModel.fit(CONTACTS)


def found(text):
    return [(k, text[a:b]) for a, b, k in pii.find(text, MODEL)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("write to a.b+c@mail.example.", [("email", "a.b+c@mail.example")]),
        ("A_B9@SUB.POST.TEST; x", [("email", "A_B9@SUB.POST.TEST")]),
        ("mailto:x9(at)mail.test or y.z [at] post [dot] test", [("email", "x9(at)mail.test"), ("email", "y.z [at] post [dot] test")]),
        ("reach ab.c at inbox dot test today", [("email", "ab.c at inbox dot test")]),
        ("the yoga@sunrise class, tag @toolbox, look at the dot on it", []),
        ("Call +44 20 7946 0280, ring", [("phone", "+44 20 7946 0280")]),
        ("(555) 555-0120 or 555-555-0166 or 030/23125050", [("phone", "(555) 555-0120"), ("phone", "555-555-0166"), ("phone", "030/23125050")]),
        ("+33.1.99.00.96.81 / 06 39 98 46 42 / 00447700900328", [("phone", "+33.1.99.00.96.81"), ("phone", "06 39 98 46 42"), ("phone", "00447700900328")]),
        ("Order 514-7969180-4462566, GPS 27.98, -25.80, at 12:30 on 2024-01-02", []),
        ("Her number is 931-42-2703.", [("id_number", "931-42-2703")]),
        ("QQ 00 40 94 A and ID616.748.802 (37495095-G) X92696779", [("id_number", "QQ 00 40 94 A"), ("id_number", "ID616.748.802"), ("id_number", "37495095-G"), ("id_number", "X92696779")]),
        ("flight QQ 1255, reference KL7267, code ZX1183495397", []),
        ("at Rosenstraße 71, ring", [("address", "Rosenstraße 71")]),
        ("35b Quarry Hill Gardens | 9 Sorrel Close Then", [("address", "35b Quarry Hill Gardens"), ("address", "9 Sorrel Close")]),
        ("28 rue des Cerisiers Call, Avenida de los Pinos, 40", [("address", "28 rue des Cerisiers"), ("address", "Avenida de los Pinos, 40")]),
        ("LANTERN ROAD 120 but Sorrel Street shows 256 clocks", [("address", "LANTERN ROAD 120")]),
        ("Davirik Ashagate and Fenarec X. Crowagate", [("name", "Davirik Ashagate"), ("name", "Fenarec X. Crowagate")]),
        ("Dr. Brackafield moved; Frau Xyloph, 3; Hi Davodra, the", [("name", "Brackafield"), ("name", "Xyloph"), ("name", "Davodra")]),
        ("The Ashagate Bakery opens; meet at Crowavik Park", []),
        ("Guest name: ASHAVIK, Briarec", [("name", "ASHAVIK, Briarec")]),
        ("thanks to briarec ashavik for", [("name", "briarec ashavik")]),
        ("Signed by K. Ashafield on Monday", [("name", "K. Ashafield")]),
        ("", []),
    ],
)
def test_found(text, want):
    assert found(text) == want


def test_names_of_any_length_and_make():
    """Names that the address book has are found however short they are, of several words, or with capitals inside."""
    model = pii.NameModel.fit([("Anna", "Lee"), ("Kim", "Wu"), ("Bo", "Ek"), ("Jean-Luc", "O’Neill"), ("Eva", "de la Cruz"), ("Max", "McDonald")])
    cases = {
        "met Anna at noon": ["Anna"],
        "so Kim Wu and Bo Ek ate": ["Kim Wu", "Bo Ek"],
        "ring Mr Li or Ms. Wu now": ["Li", "Wu"],
        "by K. Lee today": ["K. Lee"],
        "LEE, Anna and anna lee": ["LEE, Anna", "anna lee"],
        "saw Jean-Luc O'Neill and Eva de la Cruz; Jean-Luc": ["Jean-Luc O'Neill", "Eva de la Cruz", "Jean-Luc"],
        "with Max McDonald": ["Max McDonald"],
        "as Tom O'Neill said": ["Tom O'Neill"],
        "the lee side, de la mar": [],
    }
    known: dict = {}
    for text, want in cases.items():
        for memo in (None, known, known):
            assert [text[a:b] for a, b, _ in pii.find(text, model, memo)] == want, text


def test_rest_is_unchanged_and_equal_values_stay_linked():
    text = "A +44 20 7946 0280, B +44 20 7946 0280; Briarec Ashavik!\n"
    out, kinds, vals = pii.redact_text(text, MODEL, b"k")
    assert kinds == ["phone", "phone", "name"] and vals[0] == vals[1]
    first, second = out.split("[PHONE ")[1:3]
    assert first.split("]")[0] == second.split("]")[0] != "+44 20 7946 0280"
    assert out.startswith("A [PHONE +44 ") and out.endswith("]!\n") and "Ashavik" not in out
    assert pii.redact_text(text, MODEL, b"other")[0] != out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 15])
def test_feistel_is_a_permutation(n):
    rng = random.Random(n)
    values = [f"{i:0{n}d}" for i in (range(10**n) if n < 4 else rng.sample(range(10**n), 500))]
    out = [pii.permute(v, b"key", "phone") for v in values]
    assert len(set(out)) == len(values) and all(len(o) == n and o.isdigit() for o in out)
    assert [pii.restore(o, b"key", "phone") for o in out] == values
    assert out != values


FORMS = ["QQ 00 40 94 A", "AB 12 34 56 C", "ID616.748.802", "37495095-G", "12345678Z", "X2692677T", "X92696779", "AB1234567", "MORGA657054SM9IJ", "86 095 742 719", "931-42-2703", "219-09-9999"]


@pytest.mark.parametrize("value", FORMS)
def test_numbers_keep_format_and_validity_but_no_run(value):
    shape = lambda v: "".join("0" if c.isdigit() else "A" if c.isupper() else c for c in v)
    outs = [pii.permute(value, bytes([k + 1])) for k in range(40)]
    for k, o in enumerate(outs):
        assert shape(o) == shape(value) and pii.valid_number(o) == pii.valid_number(value)
        assert pii.restore(o, bytes([k + 1])) == value
    assert len(set(outs)) > 35
    free = [i for i, c in enumerate(value) if c.isalnum() and i not in pii._fixed("id_number", value)]
    for i in free[:-1]:  # every place changes with the key
        assert len({o[i] for o in outs}) > 1, (value, i)
    assert all(o != value for o in outs)


def test_check_letters():
    assert pii.valid_number("12345678Z") and not pii.valid_number("12345678A")
    assert pii.valid_number("X2482300W") and pii.valid_number("Z8327649K") and not pii.valid_number("Z8327649L")
    assert pii.valid_number("86 095 742 719") and not pii.valid_number("86 095 742 718")


def test_birth_dates():
    text = "Briarec Ashavik, born 29.02.1984, met us on 2024-03-01; date of birth: 1990-12-31; born 31.02.1990"
    out, kinds, vals = pii.redact_text(text, MODEL, b"k", births=True)
    assert kinds == ["name", "birth_date", "birth_date"] and vals[1:] == ["29.02.1984", "1990-12-31"]
    assert "2024-03-01" in out and "31.02.1990" in out and "29.02.1984" not in out
    assert pii.redact_text(text, MODEL, b"k")[1] == ["name"]
    for v in ("29.02.1984", "1990-12-31", "01/01/1880"):
        o = pii.permute(v, b"k", "birth_date")
        assert pii._day(o) is not None and pii.restore(o, b"k", "birth_date") == v != o


def test_many_pieces_in_one_text():
    """Eighty thousand pieces in one text take seconds."""
    began = time.time()
    spans = pii.find(" ".join(f"+44 20 7946 {i % 10000:04d}" for i in range(80_000)), MODEL)
    assert len(spans) == 80_000 and time.time() - began < 20


def test_columns_with_nulls_long_texts_and_clashes(spark, rows):
    data = [(1, None, "k"), (2, "", "k"), (3, "x " * 200_000 + "a.b@c.test", "k")]
    df = spark.createDataFrame(data, "id bigint, text string, kinds string")
    got = rows(df.select("id", pii.redacted(F.col("text"), MODEL, b"k").alias("r")).select("id", F.length("r.text"), "r.kinds"))
    assert [r[2] for r in got] == [[], [], ["email"]] and got[0][1] is None and got[1][1] == 0
    assert rows(df.where("id > 9").select(pii.redacted(F.col("text"), MODEL, b"k"))) == []
    with pytest.raises(ValueError):
        pii.redacted(F.col("text"), MODEL, b"")
    assert pii.fit_names(spark.createDataFrame(CONTACTS, "given_name string, family_name string")).given == MODEL.given
