"""Text normalization as pure Column expressions: nothing leaves the JVM.

All functions give null for null. Sentences hold no line breaks, so ``^`` and ``$`` mean the ends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rookery.functions import rules


def apply_rules(text: Column, table: list[tuple[str, str]]) -> Column:
    for pattern, to in table:
        text = F.regexp_replace(text, F.lit("(?d)" + pattern), F.lit(to))
    return text


def squeeze(text: Column) -> Column:
    """No white space at the ends, one space for each run inside."""
    return apply_rules(text, rules.SQUEEZE)


def transliterate(text: Column) -> Column:
    """ASCII only: accents dropped, symbols spelled, all else a space; a last single character becomes a full stop."""
    for char, words in rules.SPELLED.items():
        text = F.replace(text, F.lit(char), F.lit(words))
    text = F.translate(text, "".join(rules.TRANSLITERATED), "".join(rules.TRANSLITERATED.values()))
    return apply_rules(squeeze(F.regexp_replace(text, r"[^\x00-\x7E]", " ")), rules.LAST_CHARACTER)


def remove_meta(text: Column) -> Column:
    """Without @names and repost marks; hashtags stay."""
    return squeeze(apply_rules(text, rules.META))


def remove_punctuation(text: Column) -> Column:
    """Without punctuation that is no part of a word or a sentence's end."""
    return squeeze(apply_rules(text, rules.PUNCTUATION))


def remove_markup(text: Column) -> Column:
    return squeeze(apply_rules(text, rules.MARKUP))


def canonical_laughs(text: Column) -> Column:
    return apply_rules(text, rules.LAUGHS)


def cap_repeats(text: Column) -> Column:
    """Three or more equal characters become three; laughter takes one form."""
    return canonical_laughs(apply_rules(text, rules.ELONGATION))


def remove_word_ends(text: Column) -> Column:
    """Without full stops, question and exclamation marks at the ends of words."""
    return squeeze(apply_rules(text, rules.WORD_ENDS))


def sentences(text: Column) -> Column:
    """Sentences in order, without white space at their ends and without empty ones."""
    for mark, broken in rules.SENTENCE_BREAKS:
        text = F.replace(text, F.lit(mark), F.lit(broken))
    return F.filter(F.transform(F.split(text, "\n", -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def normalize_sentence(text: Column) -> Column:
    text = cap_repeats(remove_markup(remove_punctuation(remove_meta(transliterate(text)))))
    text = apply_rules(text, rules.BLANKS)
    return F.when(text == " ", "").otherwise(text)


def normalize(text: Column) -> Column:
    """All stages for each sentence; empty ones are dropped, the rest joined by single spaces."""
    return F.array_join(F.filter(F.transform(sentences(text), normalize_sentence), lambda s: s != ""), " ")


# Fixed value: marks that the plain helpers know.
MARKS = r'[-,?!,":;.()]'


def without_marks(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, "")


def marks_to_spaces(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, " ")


def clean_words(words: Column) -> Column:
    """Links as they are; other words in lower case without ASCII punctuation; stop words and empty ones dropped."""
    link = lambda w: w.contains("http:") | w.contains("https:")
    stop = F.array(*(F.lit(w) for w in rules.STOP_WORDS))
    bare = F.transform(words, lambda w: F.when(link(w), w).otherwise(F.lower(F.translate(w, rules.ASCII_PUNCTUATION, ""))))
    return F.filter(bare, lambda w: link(w) | ((w != "") & ~F.array_contains(stop, w)))


def count_words(text: Column) -> Column:
    """Words of a normalized message for counting: lower case, no marks at word ends; ``['']`` for an empty one."""
    return F.split(remove_word_ends(F.lower(text)), " ", -1)
