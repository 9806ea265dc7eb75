"""Fixed values of the text normalizer: patterns, replacements, characters and word lists."""

import unicodedata

# Ordered (pattern, replacement) rules; $1 stands for the first group.
SQUEEZE = [(r"^\s+", ""), (r"\s+$", ""), (r"\s+", " ")]
LAST_CHARACTER = [(r"\s+.$", ".")]
META = [(r"@[a-zA-Z0-9_]+", " "), (r"\sRT\s", " "), (r"^RT\s", " ")]
PUNCTUATION = [
    (r"^-+", ""), (r"--+", ""), (r"\s-+", ""), (r"~", " "), (r'"', ""),
    (r"^'+", ""), (r"'+$", ""), (r"'+\s+", " "), (r"\s+'+", " "), (r"\s+`+", " "), (r"^`+", " "),
    (r":\s", " "), (r":$", ""), (r";\s", " "), (r";$", ""),
    (r"_+\s", " "), (r"^_+", ""), (r"_+$", ""), (r"__+", " "),
    (r",+([#A-Za-z])", " $1"), (r",+$", " "), (r",\.\s", " "), (r",\s", " "),
    (r"\s\*+", " "), (r"\*+\s", " "), (r"\*\.", " "), (r"\s\*+\s", " "), (r"^\*+", ""), (r"\*+$", ""),
    (r"\?[!?]+", "?"), (r"![?!]+", "!"), (r"\.\.+", "."),
    (r"\s/", " "), (r"/\s", " "), (r"\|", " "), (r"\\", " "),
    (r"\(([@#A-Za-z0-9])", "$1"), (r"([@#A-Za-z0-9])\)", "$1 "),
]
MARKUP = [
    (r"<\S+>", " "), (r"https?://?\s*\S+\s", " "), (r"https?://?\s*\S+$", ""), (r"\(https?:\\\S+\)", " "),
    (r"\(?www\.\S+\)?", " "), (r"\[ID:[^\]]+\]", " "), (r"\[id:[^\]]+\]", " "), (r"\(PDF\)", " "),
    (r"&mdash;", " "), (r"&quot;", " "), (r"&#39;", " "),
]
ELONGATION = [(r"(.)\1{2,}", "$1$1$1")]
LAUGHS = [(r"(ja|Ja)(ja|Ja)+(j)?", "jaja"), (r"(rs|Rs)(Rs|rs)+(r)?", "rsrs"), (r"(ha|Ha)(Ha|ha)+(h)?", "haha")]
BLANKS = [(r"\s+", " ")]
WORD_ENDS = [(r"^(\S+)[.!?]", "$1"), (r"\s(\S+)[.!?]", " $1"), (r"(\S+)[.!?]$", "$1"), (r"\s[.!?]\s", " "), (r"^[.!?]$", "")]
SENTENCE_BREAKS = [(". ", ".\n\n"), ("? ", "?\n\n"), ("! ", "!\n\n"), ('."', '."\n\n')]

# Characters that become several.
SPELLED = {
    "¢": " cents ", "£": " pounds ", "¥": " yen ", "°": " degrees ", "±": " plus-or-minus ", "µ": " micro ", "¼": " 1/4 ", "½": " 1/2 ", "¾": " 3/4 ",
    "Æ": "AE", "Ð": "Th", "Þ": "Th", "ß": "ss", "æ": "ae", "ð": "th", "÷": " divided by ", "þ": "th",
    "Ĳ": "IJ", "ĳ": "ij", "Œ": "oe", "ƕ": "hv", "Ω": " omega ", "β": " beta ", "μ": " mu ", "π": " pi ", "€": " euros ", "⅔": "2/3", "ﬁ": "fi",
}
# Characters that become one other than the letter below their accents.
SINGLE = dict(
    zip(
        "´×ØøĐđĦħıĸĿŀŁłŉŊŋœŦŧſƀƁƂƃƄƅƆƇƈƉƊƋƌƐƑƒƓƖƗƘƙƚƝƞƟȦΑΤсύ‐‑‘’ ′−",
        "'xOoDdHhikLlLlnNnRTtsbBBbbbOCcDDddEFfGIIKklNnOaATcu--''\n'-",
        strict=True,
    )
)


def _base(char: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
    return plain if len(plain) == 1 and plain.isascii() else " "


#: Every character from U+00A0 to U+019F and three more lose their accents, as far as a plain letter is below them.
TRANSLITERATED = {c: _base(c) for c in [*map(chr, range(0xA0, 0x1A0)), "ȧ", "ḥ", "ị"] if c not in SPELLED} | SINGLE

# English stop words of the word-list cleaner.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into through during before after above below to from "
    "up down in out on off over under again further then once here there when where why how all any both each few more most other some such no "
    "nor not only own same so than too very s t can will just don should now rt"
).split()
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
