"""Token ids against two public libraries, and an exact round trip."""

import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rookery.llm.bpe import TOKENIZERS, RankQueue, encoder, token_counts, token_ids, vocabulary_path

pytestmark = pytest.mark.skipif(not os.path.exists(vocabulary_path("byte_bpe_50k")), reason="no vocabulary files")
SCHEMA = "doc_id long, text string, ids string, n_tokens int"
TEXTS = [
    "", None, " ", "\n\n  \n", "Hello world", "don't I'll 've", "naïve café — ½ ²", "日本語 🐟👀 ok", "<|endoftext|> x", "a" * 5_000, " " * 3_000, "ab" * 20_000, "  x　 ​",
    "x\x00\x1f\x85y", "Ünïcödé" * 50, "١٢٣ ⅷ", "\ttab\r\nnew", "é́" * 100, "?!…" * 30, "'S 'T it's",
]


def libraries():
    import tiktoken
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    hf.encode_special_tokens = True
    with open(vocabulary_path("byte_bpe_50k"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return hf, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


def test_same_ids(spark):
    hf, tk, ranks = libraries()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "null key", "", 0), (0, "again", "", 0)], SCHEMA)
    rows = [(r["doc_id"], list(r["ids"])) for r in token_ids(df, "doc_id", "text").collect()]
    assert len(rows) == len(TEXTS) + 2
    assert sorted(ids for key, ids in rows if key in (0, None)) == sorted([[], tk.encode_ordinary("again"), tk.encode_ordinary("null key")])
    got, back = dict(r for r in rows if r[0]), {v: k for k, v in ranks.items()}
    for i, text in enumerate(TEXTS[1:], 1):
        assert got[i] == (tk.encode_ordinary(text) if text else [])
        assert got[i] == hf.encode(text or "", add_special_tokens=False).ids
        assert b"".join(back[t] for t in got[i]) == (text or "").encode()
    assert sorted(r["n_tokens"] for r in token_counts(df, "doc_id", "text").collect()) == sorted(len(ids) for _, ids in rows)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aab thes'1 é日\n"), max_size=60) | st.binary(max_size=40).map(lambda b: b.decode("latin-1")))
def test_merges(text):
    _, tk, _ = LIBS
    own = encoder(vocabulary_path("byte_bpe_50k"))
    assert own.merge(text.encode()) == (tk._core_bpe.encode_single_piece(text.encode()) if text else [])


LIBS = libraries() if os.path.exists(vocabulary_path("byte_bpe_50k")) else None


@given(st.lists(st.tuples(st.integers(0, 260_000), st.integers(0, 50)), max_size=60))
def test_queue(pairs):
    q = RankQueue()
    for rank, position in pairs:
        q.push(rank, position)
    got = []
    while (x := q.pop()) is not None:
        got += [(x[0], p) for p in x[1]]
    assert got == sorted(pairs)


def test_other_vocabulary_and_empty_table(spark):
    df = spark.createDataFrame([(1, "Привет мир", "", 0)], SCHEMA)
    assert token_counts(df, "doc_id", "text", "byte_bpe_multi_50k").first()["n_tokens"] > 0
    assert token_ids(df.limit(0), "doc_id", "text").count() == 0
