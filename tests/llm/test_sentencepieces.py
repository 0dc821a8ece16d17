"""Ids against the library's own, and against plain merging; pairs, nulls, empty and long texts, clashing columns."""

import hashlib
import random

import pytest
from sentencepiece import SentencePieceProcessor

from bubblestat.llm import sentencepieces
from bubblestat.llm.queries import PIECE_MODEL, QUERIES

RNG = random.Random(13)


@pytest.fixture(scope="module")
def table():
    return sentencepieces.PrefixTable(PIECE_MODEL)


def _merged(table, text):
    """Tokens by merging, step after step."""
    parts = list(text)
    while True:
        scores = [table.score.get(a + b) for a, b in zip(parts, parts[1:])]
        known = [s for s in scores if s is not None]
        if not known:
            return parts
        i = scores.index(max(known))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def _texts(table, n):
    pieces, letters = list(table.ids), "abcdeé  ▁\n\t019.,ñ梦벨　\U0001f600ঙßtheinrІ\x00\x7f<>/s"
    for _ in range(n):
        yield "".join(RNG.choice(letters) if RNG.random() < 0.5 else RNG.choice(pieces) for _ in range(RNG.randint(0, 14))).replace("▁", RNG.choice([" ", "▁"]))


def test_prefix_tokens_are_those_of_merging(table):
    for text in _texts(table, 1500):
        marked = text.replace(" ", "▁")
        assert table.tokens(marked) == _merged(table, marked)


def test_pairs_stay_apart_as_merging_says(table):
    pieces = list(table.ids)
    for _ in range(3000):
        a, b = RNG.choice(pieces), RNG.choice(pieces)
        if RNG.random() < 0.5:
            whole = RNG.choice([p for p in (RNG.choice(pieces) for _ in range(20)) if len(p) > 1] or ["ab"])
            i = RNG.randint(1, len(whole) - 1)
            a, b = whole[:i], whole[i:]
        assert table.stays_apart(a, b) == (_merged(table, a + b) == [a, b])


def test_rows_equal_the_library(spark, table):
    library = SentencePieceProcessor(model_file=PIECE_MODEL)
    texts = [*_texts(table, 400), None, "", " ", "  two  ", "ab" * 40_000, "word " * 50_000, "<s></s><unk><0x41>", "same", "same"]
    rows = [(i if i % 50 else None, t, "ids", "row") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, text_back string").repartition(3)
    for end in (True, False):
        got = sentencepieces.decoded(sentencepieces.encoded(docs, PIECE_MODEL, end), PIECE_MODEL)
        assert got.select("row.*").columns == docs.columns
        have = sorted((r["row"]["doc_id"] or -1, r["row"]["text"] or "", list(r["ids"]), r["text_back"]) for r in got.collect())
        ids = [library.encode(t or "", add_eos=end) for t in texts]
        want = sorted((r[0] or -1, r[1] or "", x, library.decode(x) if x else "") for r, x in zip(rows, ids))
        assert have == want
        one = sentencepieces.encoded(docs, PIECE_MODEL, end, back=True).collect()
        assert sorted((r["row"]["doc_id"] or -1, r["row"]["text"] or "", list(r["ids"]), r["text_back"]) for r in one) == want
    assert sentencepieces.encoded(docs.limit(0), PIECE_MODEL).count() == 0


def test_kept_segments_start_anew(monkeypatch, table):
    monkeypatch.setattr(sentencepieces, "KEPT", 3)
    own = sentencepieces.PrefixTable(PIECE_MODEL)
    for text in _texts(own, 60):
        assert own.encode(text) == table.encode(text)


def test_used_segments_stay(monkeypatch, table):
    """What is used again isn't encoded again, and what is kept is bounded."""
    monkeypatch.setattr(sentencepieces, "KEPT", 20)
    own, asked = sentencepieces.PrefixTable(PIECE_MODEL), []
    whole = own._ids
    own._ids = lambda s: asked.append(s) or whole(s)
    for k in range(30):
        text = "common words " + " ".join(f"{chr(97 + k % 26)}{chr(97 + j)}x" for j in range(15))
        assert own.encode(text) == table.encode(text)
        assert k == 0 or not any("common" in s for s in asked)
        asked.clear()
        assert len(own.known) + len(getattr(own, "older", ())) < 100


def test_query(spark):
    import pyarrow.parquet as pq

    library = SentencePieceProcessor(model_file=PIECE_MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for row in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist():
        ids = library.encode(row["text"] or "", add_eos=True)
        want[row["doc_id"]] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    got = QUERIES["op13_sentencepiece"](spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want and len(got) == len(want)
