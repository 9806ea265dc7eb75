"""Skeletons and the pairs of unlike texts that share one."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rookery.llm import skeleton as sk
from rookery.llm.skeleton import Prototypes, letters_only, look_classes, look_same, prototype, public_look_alikes, skeleton

SCHEMA = "kind string, id long, text string, look string, text_key string"


@pytest.fixture(scope="module")
def known(spark):
    return Prototypes(public_look_alikes(spark))


@pytest.mark.parametrize("pair", "νv ρp αa кk ոn օo ᎪA ϲc υu уy ҮY ѵv ԁd һh ΟO ѕs іi јj рp хx сc еe оo аa ВB НH".split() + ["ӕae"])
def test_letters_of_other_scripts(known, pair):
    assert skeleton(pair[0], known) == skeleton(pair[1:], known)


def test_public_table(spark):
    public = public_look_alikes(spark)
    assert len(public) > 4_000
    assert letters_only({"І": "l", "ӏ": "l", "٠": ".", "1": "l", "ꭑ": "rn", "б": "6"}) == {"І": "I", "ӏ": "l", "ꭑ": "m"}
    with pytest.raises(ValueError, match="no table"):
        sk.read_confusables(bytes(200))


@pytest.mark.parametrize(
    ("a", "b"),
    [("Ｈｅｌｌｏ１", "Hello1"), ("café", "café"), ("pay​pal", "paypal"), ("a b", "a b"), ("раураl", "paypal"), (" a \t\n b ", "a b"), ("ﬁn", "fin"), ("﻿x­", "x"), ("ёж", "ёж"), ("А̊", "Å")],
)
def test_look_alike(known, a, b):
    assert skeleton(a, known) == skeleton(b, known)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("é", "e"), ("1", "l"), ("0", "O"), ("a.", "a,"), ("x²", "x2"), ("ab", "a b"), ("①", "1"), ("rn", "m"), ("-", "—"), ("I", "l"), ("O", "0"), ("’", "'"), ("п", "n")])
def test_unlike(known, a, b):
    assert skeleton(a, known) != skeleton(b, known)


@settings(suppress_health_check=[HealthCheck.function_scoped_fixture], deadline=None)
@given(st.text())
def test_skeleton_is_stable(known, text):
    once = skeleton(text, known)
    assert skeleton(once, known) == once
    assert skeleton(" " + text + "​\n", known) == once


@settings(suppress_health_check=[HealthCheck.function_scoped_fixture], deadline=None)
@given(st.characters())
def test_prototypes_are_final(known, c):
    assert "".join(prototype(x, known.public) for x in prototype(c, known.public)) == prototype(c, known.public)


def test_pairs(spark):
    rows = [("u", 1, "Bob"), ("u", 2, "Bоb"), ("u", 3, "Bob"), ("u", 4, "bob"), ("u", 5, None), ("u", 6, ""), ("u", 7, "  "), ("u", None, "Bob"), ("t", 8, "Ｂob"), ("t", 9, "Bob "), ("u", 2, "Bоb"), ("u", 2, "Bob"), ("t", 10, "x" * 40_000), ("t", 11, "х" * 40_000)]
    df = spark.createDataFrame([(*r, "l", "k") for r in rows], SCHEMA)
    assert sorted(map(tuple, look_same(df).collect())) == [("t", 8, 9), ("t", 10, 11), ("u", 1, 2), ("u", 2, 3)]
    assert sorted(map(tuple, look_classes(df).collect())) == [("t", 8, 8, 2), ("t", 9, 8, 2), ("t", 10, 10, 2), ("t", 11, 10, 2), ("u", 1, 1, 2), ("u", 2, 1, 2), ("u", 3, 1, 2)]


def test_copies_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sk, "MEMBERS", 7)
    df = spark.createDataFrame([("t", i, "same" if i % 2 else "ѕame", "", "") for i in range(60)], SCHEMA)
    assert sorted(map(tuple, look_same(df).collect())) == sorted(("t", a, b) for a in range(60) for b in range(a + 1, 60) if (a + b) % 2)


def test_copies_are_no_pairs(spark):
    df = spark.createDataFrame([("t", i, "same", "", "") for i in range(500)] + [("t", 500, "ѕame", "", "")], SCHEMA)
    assert look_same(df).count() == 500


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert look_same(df).count() == look_classes(df).count() == 0
