"""Texts that look the same: skeletons from a look-alike table, and pairs of unlike texts with equal ones.

The skeleton of a text is: canonical decomposition, each character replaced by its prototype,
canonical decomposition again, white space in runs as one space and none at the ends. Prototypes
come from Unicode's decompositions and from the public table of confusable characters, which is read
from the ICU library that Spark ships. Of that table only letters count whose prototypes are letters,
and ASCII characters stand for themselves: upper and lower case, digits and punctuation are visible.
"""

from __future__ import annotations

import struct
import unicodedata
import warnings
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.session import materialise

# Letters of other scripts and their Latin look-alikes; these go before the public table.
LOOK_ALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХасекорѕіјухһԁԛԝӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοɑɡıℓ‐‑",
        "ABESIJKMHOPCTYXacekopsijyxhdqwlABEZHIKMNOPTYXoagil--",
        strict=True,
    )
)
#: Kinds of compatibility decomposition whose two sides look the same; superscripts, circles and the like don't.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")


CONFUSABLES = "com/ibm/icu/impl/data/icudata/confusables.cfu"
#: Ids of one text that are dealt together.
MEMBERS = 5_000


def read_confusables(data: bytes) -> dict[str, str]:
    """Character and prototype of each entry of the library's binary table.

    Behind a header whose size comes first, the table has nine numbers (three for its kind, then place
    and number of keys, values and string units). A key is a code point with the length of its
    prototype, less one, in the upper eight bits; a value is the only unit of the prototype or its
    place in the string.
    """
    at = struct.unpack_from(">H", data)[0]
    magic, _, _, key_at, n, value_at, _, text_at, _ = struct.unpack_from(">9i", data, at)
    if magic != 0x3845FDEF:
        raise ValueError("no table of confusable characters")
    keys, values = struct.unpack_from(f">{n}I", data, at + key_at), struct.unpack_from(f">{n}H", data, at + value_at)
    text = data[at + text_at :]
    out = {}
    for key, value in zip(keys, values, strict=True):
        length = (key >> 24) + 1
        out[chr(key & 0xFFFFFF)] = chr(value) if length == 1 else text[2 * value : 2 * (value + length)].decode("utf-16-be")
    return out


def letters_only(table: dict[str, str]) -> dict[str, str]:
    """Entries from letters to letters. The public table takes I for l and m for rn; here each of these stays itself."""

    def kind(text: str) -> set[str]:
        return {unicodedata.category(c)[0] for c in text}

    out = {}
    for char, to in table.items():
        if char.isascii() or kind(char) != {"L"} or not kind(to) <= {"L", "M"}:
            continue
        out[char] = "I" if to == "l" and unicodedata.category(char) == "Lu" else "m" if to == "rn" else to
    return out


@lru_cache(maxsize=1)
def _public(app: str) -> dict[str, str]:
    spark = SparkSession.getActiveSession()
    stream = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().getResourceAsStream(CONFUSABLES)
    if stream is None:
        warnings.warn(f"{CONFUSABLES} isn't there; only the fixed look-alikes are known", stacklevel=2)
        return {}
    return letters_only(read_confusables(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))


def public_look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letters of the public table with their prototypes, about 4,500."""
    return _public(spark.sparkContext.applicationId)


def prototype(char: str, public: dict[str, str]) -> str:
    """The character or characters that stand for ``char`` in skeletons; empty for invisible ones."""
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    if char.isspace():
        return " "
    if unicodedata.category(char) == "Cf" or char in "͏ᅟᅠ᠋᠌᠍ㅤ" or "︀" <= char <= "️":
        return ""
    if char in public:
        return public[char]
    kind, *codes = unicodedata.decomposition(char).split() or [""]
    if kind in SAME_LOOK:
        parts = unicodedata.normalize("NFD", "".join(chr(int(c, 16)) for c in codes))
        return "".join(prototype(c, public) for c in parts)
    return char


class Prototypes(dict):
    """Prototype by code point, filled as characters come up."""

    def __init__(self, public: dict[str, str] | None = None):
        super().__init__()
        self.public = public or {}

    def __missing__(self, code: int) -> str:
        self[code] = out = prototype(chr(code), self.public)
        return out


def skeleton(text: str, prototypes: Prototypes) -> str:
    swapped = unicodedata.normalize("NFD", text).translate(prototypes)
    return " ".join(unicodedata.normalize("NFD", swapped).split())


def skeleton_column(text: Column, public: dict[str, str]) -> Column:
    """Skeleton of a text column. Texts of printable ASCII never leave the JVM: theirs only squeezes white space."""
    held: list[Prototypes] = []

    def run(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Prototypes(public))
        return texts.map(lambda t: skeleton(t, held[0]), na_action="ignore")

    folded = F.pandas_udf(run, "string")
    plain = ~text.rlike(r"[^\x20-\x7E\t\n\r]")
    squeezed = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    return F.when(plain, squeezed).otherwise(folded(F.when(~plain, text)))


def _fingerprints(texts: DataFrame) -> DataFrame:
    """``kind, id, text_key, look_key`` (128 bits each), once for each id and text; the skeleton is made once for each row."""
    look = skeleton_column(F.col("text"), public_look_alikes(texts.sparkSession))
    rows = texts.where(F.col("id").isNotNull() & (F.col("text") != "")).select("kind", "id", F.unhex(F.md5("text")).alias("text_key"), F.unhex(F.md5(F.nullif(look, F.lit("")))).alias("look_key"))
    # blank texts are left out after writing: a filter here would be pushed below the function and run it again
    return materialise(rows.distinct(), "looks").where("look_key IS NOT NULL")


def _varied(keys: DataFrame) -> DataFrame:
    """Only rows whose skeleton is that of two texts or more."""
    short = F.xxhash64("text_key")
    several = keys.groupBy("kind", "look_key").agg(F.min(short).alias("lo"), F.max(short).alias("hi")).where("lo <> hi").select("kind", "look_key")
    return keys.join(several, ["kind", "look_key"], "left_semi")


def look_same(texts: DataFrame) -> DataFrame:
    """``kind, id_a, id_b``: pairs of ids, ``id_a < id_b``, whose texts look the same but differ.

    ``texts`` has ``kind, id, text``; ids are compared within a kind. Equal texts are no pair, so
    copies never meet each other: pairs are made between distinct texts of one skeleton and only
    then spread over the ids that have these texts. Null, empty and blank texts and null ids are
    left out. An id with several texts is never paired with itself.
    """
    members = materialise(_varied(_fingerprints(texts)), "varied")
    distinct = members.groupBy("kind", "look_key", "text_key").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    # the ids of one text are dealt into parts, so that a text of very many copies is many groups
    ids = members.join(distinct.select("kind", "text_key", "parts"), ["kind", "text_key"]).select("kind", "text_key", "id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    ids = materialise(ids, "ids")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = distinct.select("kind", "look_key", F.col("text_key").alias("text_a"), every.alias("part_a"))
    b = distinct.select("kind", "look_key", F.col("text_key").alias("text_b"), every.alias("part_b"))
    classes = a.join(b, ["kind", "look_key"]).where("text_a < text_b").select("kind", "text_a", "part_a", "text_b", "part_b")
    x = ids.select("kind", F.col("text_key").alias("text_a"), F.col("part").alias("part_a"), F.col("id").alias("x"))
    y = ids.select("kind", F.col("text_key").alias("text_b"), F.col("part").alias("part_b"), F.col("id").alias("y"))
    pairs = classes.join(x, ["kind", "text_a", "part_a"]).join(y, ["kind", "text_b", "part_b"]).where("x <> y")
    return pairs.select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def look_classes(texts: DataFrame) -> DataFrame:
    """``kind, id, class_id, n_texts``: members of every class of two or more unlike texts; ``class_id`` is its least id."""
    members = materialise(_varied(_fingerprints(texts)), "varied")
    sums = members.groupBy("kind", "look_key").agg(F.min("id").alias("class_id"), F.count_distinct("text_key").alias("n_texts"))
    return members.join(sums, ["kind", "look_key"]).select("kind", "id", "class_id", "n_texts").distinct()
