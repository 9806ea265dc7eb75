"""Free-form language labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How profiles and documents name the languages.
NAMES = {
    "en": ["en", "eng", "english"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "ru": ["ru", "rus", "russian", "русский"],
}


def named_language(label: Column) -> Column:
    """The language a label names (``en``, ``EN_us``, `` eng``, ``English``); null for any other, empty and null ones."""
    first = F.regexp_extract(F.lower(F.trim(label)), r"^([^\s_.,;()/-]+)", 1)
    return F.coalesce(*(F.when(first.isin(names), F.lit(code)) for code, names in NAMES.items()))
