"""The operators on small rows: plain versions' results, nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import io
import json
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import brute
from bubblestat.llm import bpe, chat, decontam, html_tree, lines, packing, quality, simhash, token_files, toxicity, urls
from bubblestat.llm.bpe import Encoder
from bubblestat.llm.components import components
from bubblestat.llm.queries import BYTE_TOKENIZER, QUERIES, WORD_TOKENIZER

RNG = random.Random(11)
VOCAB = ["".join(RNG.choice(["th", "er", "on", "an", "re", "he", "in", "é", "ß"]) for _ in range(RNG.randint(1, 4))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) + rng.choice(["", "", "", ".", ","]) + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


BASE = prose(300)
WORDS = BASE.split(" ")
DOCS = [
    (1, BASE),
    (2, BASE),
    (3, " ".join([*WORDS[:150], "changed", *WORDS[151:]])),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, "Two words"),
    (8, prose(2500)),
    (9, "A b c d e f\nA b c d e f\na b c d e g h"),
    (None, prose(40)),
    (None, prose(40)),
    (12, "line one of five words\n" * 5 + "LINE one of Five words"),
    (12, "line one of five words\n" * 5 + "LINE one of Five words"),
    (13, "the same five words here again " * 20),
    (14, "## $$ %% && || <a> *b* c d e f g"),
    (15, "tail " + "\u3000wide\xa0space\x85 x\x1cy " * 3),
]
DOCS += [(100 + i, prose(RNG.randint(1, 80))) for i in range(40)] + [(200 + i, " ".join(WORDS[:290] + [VOCAB[i]] + WORDS[291:])) for i in range(12)]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use inside."""
    rows = [(d, t, "fp", "hash", "_q", i) for i, (d, t) in enumerate(DOCS)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, hash string, _q string, `n.x` int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_simhash(docs, none):
    got = sorted(((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted(brute.simhash(DOCS), key=str)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    groups = {c if c is not None else f for _, f, c in brute.simhash(DOCS)}
    assert kept.count() == len(groups) and {r["doc_id"] for r in kept.collect()} <= groups | {None}
    assert simhash.representatives(none).count() == 0


def test_links_of_close_fingerprints_are_found(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for f in fps[:30]:
        fps += [f ^ (1 << rng.randrange(64)), f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(f,) for f in signed], "fp long").select("fp", F.explode(simhash.anchors(F.col("fp"))).alias("a")).collect()
    at = {}
    for r in rows:
        at.setdefault(r["fp"], set()).add(r["a"])
    for i, x in enumerate(signed):
        assert len(at[x]) in (1, 32)
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                assert at[x] & at[signed[j]]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_counts(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 0), (14, None)], "doc_id long, quality int")
    got = quality.judged(docs, labels)
    keys = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted((str(r["doc_id"]), *(r[k] for k in keys)) for r in got.collect()) == sorted((str(d), *brute.counts(t)) for d, t in DOCS)
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judged(none, labels).count() == 0
    assert quality.passing(docs, labels).columns == docs.columns
    assert quality.passing(docs, labels.limit(0)).count() == sum(1 for r in got.collect() if not r["base_failed"])


def test_quality_rules_are_learned(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = [w + ("###" if bad and rng.random() < 0.6 else "") for w in prose(60, rng).split()]
        texts.append((i, " ".join(words)))
        labels.append((i, int(not bad)))
    got = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert sum(got[i] == (i % 5 != 0) for i in range(400)) >= 395


def removed(df, **how):
    return lines.with_removed(df, **how).select("row.*", F.col("text").alias("left"), "removed").collect()


def test_lines(docs, none):
    docs = docs.withColumn("removed", F.lit("x")).withColumn("row", F.lit(1)).withColumn("_removed", F.lit(2))  # names of its own
    assert lines.deduplicated(docs).columns == docs.columns
    want = brute.lines(DOCS)
    got = {r["n.x"]: r for r in lines.with_removed(docs).select("row.`n.x`", "text", F.array_sort("removed").alias("gone")).collect()}
    assert len(got) == len(DOCS)
    for i, ((_, t), gone) in enumerate(zip(DOCS, want)):
        assert (got[i]["gone"] or []) == gone
        assert got[i]["text"] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone))
    assert sum(map(len, want)) > 20
    assert lines.deduplicated(none).count() == 0


@pytest.mark.parametrize("share", [50_000, 3])
def test_similar_lines_all_sizes(spark, share):
    """With lists whole, and with lists dealt in shares."""
    rng, rows = random.Random(6), []
    for i in range(60):
        own = rng.sample(VOCAB, rng.randint(1, 40))
        rows.append((2 * i, " ".join(own)))
        for k in range(6):
            some = list(own)
            for _ in range(rng.randrange(0, 1 + len(own) // 4)):
                some[rng.randrange(len(own))] = rng.choice(VOCAB)
            rng.shuffle(some)
            rows.append((2 * i + 1000 * k + 1, " ".join(some[: rng.randint(len(own) * 3 // 4, len(own))])))
    rng.shuffle(rows)
    got = {r["doc_id"]: sorted(r["removed"] or []) for r in removed(spark.createDataFrame(rows, "doc_id long, text string"), share=share)}
    assert got == {d: gone for (d, _), gone in zip(rows, brute.lines(rows))}


def test_short_lines(spark, tmp_path):
    """Short lines go as others do: equal ones of any size, and five words that hold four of an earlier line."""
    rows = [(1, "Read more\n\nMIT\na b c d\nx x y y x y x"), (2, "read MORE\n\nread\nMIT\ne a b c d\na b c"), (3, "y x\nd c b a\na b c d e f\n \nc b a\nmore read x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: sorted(r["removed"] or []) for r in removed(df)} == {1: [], 2: [0, 3, 4], 3: [0, 1, 2, 4]}
    got = {r["doc_id"]: sorted(map(int, r["gone"] or [])) for r in QUERIES["op4_lines"](spark, str(tmp_path)).selectExpr("doc_id", "split(nullif(removed_lines, ''), ',') as gone").collect()}
    assert got == {d: gone for (d, _), gone in zip(rows, brute.lines(rows))}
    done = {r["doc_id"]: sorted(r["removed"] or []) for r in removed(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(DOCS)], "doc_id long, text string"))}
    assert [done[i] for i in range(len(DOCS))] == brute.lines(list(enumerate(t for _, t in DOCS)))


def test_line_words():
    """Words of lines, texts of all shapes in one array, by slices of any size."""
    texts = [t for _, t in DOCS] + ["\n", "\n\na", "b\n", "x" * 70 + " " + "x" * 71, "", None, "a\x0bb\x0cc\rd\te", "é É Z z", "w" * 8 + " " + "w" * 9, "y"]
    h, counts, owner, number = lines._lines(pa.array(texts, pa.string()))
    want = [(i, n, brute.WORD.findall(x.translate(brute.LOWER))) for i, t in enumerate(texts) for n, x in enumerate((t or "").split("\n"))]
    assert list(zip(owner.tolist(), number.tolist(), counts.tolist())) == [(i, n, len(w)) for i, n, w in want]
    words = [x for *_, w in want for x in w]
    assert len(words) == len(h) and len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    part = pa.array(texts, pa.string()).slice(3, 5)
    assert lines._lines(part)[0].tolist() == h[sum(counts[owner < 3]) : sum(counts[owner < 8])].tolist()


def test_first_candidates_are_compared_at_once(spark, monkeypatch):
    """Tables written: lines, candidates, words and matches; what is left, its candidates, words and two turns of matches; the result."""
    written, cut = [], lines.cut
    monkeypatch.setattr(lines, "cut", lambda df, label, **options: written.append(label) or cut(df, label, **options))
    rows = [(1, "a b c d e"), (2, "a b c d e f"), (3, "x y z"), (4, "f e d c b"), (5, "b c d e f g\ng q r s t")]
    got = {r["doc_id"]: sorted(r["removed"] or []) for r in removed(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got == {d: gone for (d, _), gone in zip(rows, brute.lines(rows))}
    assert len(written) == 10


ITEMS = [(1, " ".join(WORDS[20:50])), (2, "two words"), (3, None), (4, "..."), (5, prose(13)), (5, " ".join(WORDS[100:112])), (None, "changed")]


def test_line_words_in_parts(monkeypatch):
    """Hashing a few texts at a time changes nothing: words, lines and the texts that they belong to."""
    texts = pa.array(["z"] + [t for _, t in DOCS])[1:]
    want = lines._lines(texts)
    for fine in (1, 50, 1 << 30):
        monkeypatch.setattr(lines, "FINE", fine)
        assert all(np.array_equal(a, b) for a, b in zip(lines._lines(texts), want, strict=True))
    assert [len(x) for x in lines._lines(texts[:0])] == [0, 0, 0, 0]


@pytest.mark.parametrize("size", [16 << 20, 100])
def test_decontamination(docs, none, spark, size):
    """With the benchmark sent to all tasks, and joined."""
    docs = docs.withColumns({"hits": F.lit(1), "row": F.lit(2), "a": F.lit(3), "items": F.lit("x")})  # names of its own
    long = " ".join(["filler", "words"] * 60_000 + WORDS[60:75] + ["end"] * 9)
    more = [(900, long), (901, long), (902, " ".join(WORDS[30:42])), (903, " ".join(WORDS[30:43]))]
    docs = docs.unionByName(spark.createDataFrame([(d, t, 1000 + i) for i, (d, t) in enumerate(more)], "doc_id long, text string, `n.x` int"), allowMissingColumns=True)
    items = [*ITEMS, (6, prose(5000) + " " + " ".join(WORDS[55:80])), (7, "a b c"), (7, "a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    marked = decontam.with_hits(docs, bench, block_bytes=size)
    rows = marked.select("row.`n.x`", "hits.n_words", decontam.n_hit().alias("n_hit"), "hits.items", decontam.contaminated().alias("c")).collect()
    assert len(rows) == len(DOCS) + len(more)
    named = [("" if i is None else i, t) for i, t in items]
    texts = {i: t for i, (_, t) in enumerate(DOCS)} | {1000 + i: t for i, (_, t) in enumerate(more)}
    for r in rows:
        n, hit, names, _ = brute.hits(texts[r["n.x"]], named)
        assert (r["n_words"], r["n_hit"], sorted(r["items"]), r["c"]) == (n, hit, names, hit > 0 and 20 * hit >= n)
    assert decontam.with_hits(none, bench, block_bytes=size).count() == 0
    clean = decontam.clean(docs, bench.limit(0), block_bytes=size)
    assert clean.columns == docs.columns and clean.count() == len(rows)


def test_every_shared_span_is_found():
    rng = random.Random(8)
    item = [rng.choice(VOCAB).replace(".", "") for _ in range(60)]
    block = decontam.Block([("i", b" ".join(decontam.words_of(" ".join(item))))], 13, 7)
    for a in range(0, 48):
        doc = decontam.words_of(" ".join(["zz", *item[a : a + 13], "qq"]))
        assert block.hits([doc])[0][0] == [(1, 14)]
        assert not block.hits([decontam.words_of(" ".join(["zz", *item[a : a + 12], "qq"]))])


HARD = ["", None, " ", "  a  b", "x\n y", "don't  stop", "a\x1cb \x1c c", "tab\t tab", "end ", "end\n", "<|endoftext|> hi", "hi <|endoftext|> there", "a<|endoftext|>b  c", "<|STARTOFTEXT|> <|startoftext|>x", "<|endoftext", "|>", "e\u0301 é x", "ΑΣ Σ", "hello world foo", "1 22 333's it's", "a.b !! c\n\nd", "\u3000 x", prose(500)]


@pytest.mark.parametrize("path", [BYTE_TOKENIZER, WORD_TOKENIZER])
def test_encoder(path, tmp_path):
    """Ids are the library's own, also with a tokenizer file that cuts texts in another way."""
    other = json.loads(open(path).read()) | {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}
    (tmp_path / "other.json").write_text(json.dumps(other))
    for file, plain in ((path, True), (str(tmp_path / "other.json"), False)):
        e, library = Encoder(file), Tokenizer.from_file(file)
        assert (e.kind is not None) == plain
        for _ in range(2):
            got = [x.tolist() for ids, ends in e.encode(pa.array(HARD)) for x in np.split(ids, ends[:-1])]
            assert got == [library.encode(t or "", add_special_tokens=False).ids for t in HARD]
        assert list(e.encode(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("path", [BYTE_TOKENIZER, WORD_TOKENIZER])
def test_kept_words_are_bounded(path, monkeypatch):
    """What is used again stays; what isn't goes; ids are the library's however little is kept."""
    monkeypatch.setattr(bpe, "KEPT", 300)
    e, library = Encoder(path), Tokenizer.from_file(path)
    asked = []

    class Told:
        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **how)

    e.tokenizer = Told()
    rng = random.Random(7)
    for k in range(12):
        texts = ["x common, word " + " ".join("".join(rng.choices("abcdefgh\u00e9", k=9)) + rng.choice(["", ".", "'s", "0", "-b"]) for _ in range(100)) for _ in range(2)]
        got = [x.tolist() for ids, ends in e.encode(pa.array(texts)) for x in np.split(ids, ends[:-1])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert k == 0 or not any("common" in t for t in asked)
        asked.clear()
        assert sum(len(x) for x in vars(e).values() if isinstance(x, dict)) < 1600


@pytest.mark.parametrize("path", [BYTE_TOKENIZER, WORD_TOKENIZER])
def test_words_are_kept_without_signs(path):
    """Signs, digits and line ends beside a word make no new word, and are cut off only where the tokenizer cuts."""
    e, library = Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(9)
    texts = [" ".join(w + rng.choice([",", ".", "###", "7", ".\nThe", ".\n\u00c9t\u00e9"]) for w in ("word", "stra\u00dfe", "\u00e9l\u00e8ve", "and") * 20) for _ in range(9)]
    list(e.encode(pa.array(texts)))
    assert len(e.known) < 20
    parts = [*"aB\u00e9\u00d7\u00f7\u0301\u0338=<.,#09 \n\t\u3000\u2028\u00b2\u212a", "'s", "'", "'RE", "\n\n", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    got = [x.tolist() for ids, ends in e.encode(pa.array(texts)) for x in np.split(ids, ends[:-1])]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_packing(docs, none):
    ids = {i: x for i, x in enumerate(encoded(BYTE_TOKENIZER, [t for _, t in DOCS], 1))}
    for hold in (6 << 20, 500):
        rows = packing.packed(docs.withColumn("doc_id", F.col("`n.x`").cast("long")), BYTE_TOKENIZER, 1, hold=hold).collect()
        docs_of, seqs = {}, {}
        for r in rows:
            part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert np.frombuffer(r["ids"], "<u4").tolist() == part and r["doc_tokens"] == len(ids[r["doc_id"]])
            docs_of.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
            seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        gapless = lambda x, n=None: sum(b for _, b in x) if all(a == sum(b for _, b in sorted(x)[:k]) for k, (a, _) in enumerate(sorted(x))) else -1
        assert {d: gapless(x) for d, x in docs_of.items()} == {d: len(x) for d, x in ids.items()}
        for x in seqs.values():
            n = gapless(x)
            assert n == 2048 or 0 < n < 2048 and n & (n - 1) == 0
    assert packing.packed(none, BYTE_TOKENIZER, 1).count() == 0
    for kind in ("smallint", "decimal(10,0)", "string", "int"):
        rows = packing.packed(docs.select(F.col("`n.x`").cast(kind).alias("doc_id"), "text"), BYTE_TOKENIZER, 1)
        assert rows.schema["doc_id"].dataType.simpleString() == kind and rows.select("doc_id").distinct().count() == len(DOCS)


def encoded(path, texts, end):
    tk = Tokenizer.from_file(path)
    return [tk.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def test_best_fill():
    rng = random.Random(9)
    for _ in range(300):
        counts = {rng.randint(1, 60): rng.randint(1, 3) for _ in range(rng.randint(0, 7))}
        room = rng.randint(0, 100)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        used = packing.best_fill(counts, room)
        assert all(0 < k <= counts[n] for n, k in used.items())
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room)


def test_token_files(docs, none, spark):
    order = sorted(range(len(DOCS)), key=lambda i: (DOCS[i][0] is not None, DOCS[i][0] or 0))
    ids = encoded(WORD_TOKENIZER, [t for _, t in DOCS], 2)
    docs = docs.withColumn("h", F.lit("x")).withColumn("part", F.lit(1)).withColumn("start", F.lit(1))  # names of its own
    folder, files = token_files.write(docs, WORD_TOKENIZER, 2, file_bytes=6000)
    assert files.count() > 2
    rows = sorted(token_files.read(spark, folder, files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [DOCS[i][0] for i in order]
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in rows) == sorted(ids)
    folder, files = token_files.write(none, WORD_TOKENIZER, 2)
    assert token_files.read(spark, folder, files).count() == 0


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_frames(monkeypatch):
    import zstandard

    monkeypatch.setattr(token_files, "FRAME", 64)
    out = io.BytesIO()
    w = token_files.Writer(out)
    held = {5: bytes(range(200)), None: b"abcd", 9: b"", 7: b"x" * 64}
    for d, b in held.items():
        w.add(d, b)
    w.close()
    raw = out.getvalue()
    r = token_files.Reader(File(raw))
    assert [(r.doc_id(i), r.ids(i)) for i in range(4)] == list(held.items()) and r.find(7) == [b"x" * 64] and r.find(8) == []
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw)[:200] == bytes(range(200))
    with pytest.raises(Exception):  # noqa: B017
        bad = bytearray(raw)
        bad[12] ^= 1
        token_files.Reader(File(bytes(bad))).ids(0)


def test_chat(spark):
    a = [("user", "hi"), ("bot", "yes"), ("user", None), (None, "end")]
    turns = [(c, k, *t) for c, n in ((1, 2), (2, 4), (3, 4), (4, 3), (5, 1)) for k, t in enumerate(a[:n])]
    turns += [(6, 0, "user", "other"), (7, 0, "user", "hi"), (7, 0, "user", "hi"), (None, 1, "user", "lost"), (8, None, "user", "hi"), (8, 1, "bot", "no")]
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, k string, a int").repartition(3)
    got = sorted(map(tuple, chat.rendered(df).collect()), key=str)
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    assert {r[0] for r in got} == {2, 6, 7, 8, None}
    con.execute("CREATE TABLE t AS SELECT * FROM conversations")
    assert dict((r[0], r[1]) for r in got) == {2: 4, 6: 1, 7: 2, 8: 2, None: 1}
    assert next(r[2] for r in got if r[0] == 2) == "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in a)
    assert chat.rendered(df.limit(0)).count() == 0


def test_urls(spark):
    link = '<link rel="canonical" href="{}">'
    meta = "<META content='0; url={}' http-equiv=refresh>"
    rows = [
        (1, "http://www.example.com/en/1", None, "allow", "www.example.com/en/"),
        (2, "http://EXAMPLE.com/en/1?x", "", "block", "example.com/en/"),
        (3, "http://a.example.com/fr/1", "", "allow", "com/"),
        (4, "http://x.net/es/1#f", "", "block", "net/es/"),
        (5, "http://y.org/a", link.format("http://x.net/es/1"), "block", None),
        (6, "https://y.org/b?q", meta.format("/a"), "block", None),
        (7, "http://z.org/", link.format("//q.org/k"), "allow", None),
        (8, None, link.format("http://x.net/es/1"), "allow", None),
        (9, "no scheme", "", "allow", None),
        (10, "http://b.com/x", link.format("http://x.net/es/1"), "allow", "com/"),
        (11, "http://b.com", "", "allow", None),
        (11, "http://b.com", "", "allow", None),
        (12, "http://notnet/es/", "", "allow", None),
    ]
    df = spark.createDataFrame([(*r[:3], "n", "h") for r in rows], "page_id long, url string, html string, node string, host string")
    got = urls.judged(df, urls.RULES).collect()
    assert sorted((r["page_id"], r["verdict"], r["rule"]) for r in got) == sorted((r[0], r[3], r[4]) for r in rows)
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    cols = ["page_id", "host", "path", "rule", "verdict"]
    sql = [tuple(None if x != x else x for x in r) for r in con.sql(urls.sql(urls.RULES)).fetchall()]
    assert sorted(map(str, sql)) == sorted(str(tuple(r[c] for c in cols)) for r in got)
    assert urls.judged(df.limit(0), urls.RULES).count() == 0


def test_toxicity(spark):
    rng, rows, labels = random.Random(12), [], []
    for i in range(600):
        bad = i % 4 == 0
        words = prose(30, rng).split(" ")
        if bad:
            words[rng.randrange(30)] = rng.choice(["zumpkin", "zumpkins", "grubbly"])
        if bad and rng.random() < 0.5 or rng.random() < 0.05:
            words[0] = "women"
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert len(held) > 80 and sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.97 * len(held)
    import pandas as pd

    men, women = model.score(pd.Series(["men went home", "women went home"]))
    assert abs(men - women) < 0.1 and women < 0.3
    assert all(0 <= r["score"] <= 1 for r in got)
    free = toxicity.fit(docs, labels, fairness=0.0)
    assert abs(free.weights.get("women", 0)) >= abs(model.weights.get("women", 0))
    assert toxicity.fit(docs, labels.limit(0)).weights == {}
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_counterfactuals_of_the_corpus(spark):
    """The given texts hold hardly a term of the fixed list and no words that alternate, so pairs are as many as a plain count finds; held-out accuracy stays."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    taught = docs.join(labels.where("toxic in (0, 1)"), "doc_id").where(~toxicity.held_out(F.col("doc_id"))).select("text").toPandas()["text"]
    assert model.pairs == sum(len(toxicity.swapped(t, model.swap)) for t in taught)
    held = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).where("toxic in (0, 1)").select("text", "toxic").toPandas()
    s, toxic = model.score(held["text"]), held["toxic"].to_numpy() == 1
    assert 2 * ((s >= 0.3) & toxic).sum() / ((s >= 0.3).sum() + toxic.sum()) > 0.7


def test_planted_groups_lose_their_false_positives(spark):
    """Groups that no list knows alternate in neutral sentences; one of them stands in most toxic texts. Neutral mentions of it are false positives without the penalty, and none with it."""
    import pandas as pd

    rng, groups, rows = random.Random(14), ["zorgs", "blips", "quans", "merps"], []
    insults = ["".join(rng.sample("bcdfgjklmpqvwxyz", 7)) for _ in range(25)]
    for place in "river market town school garden harbour station church forest bridge museum library castle valley island tower".split():
        rows += [(f"Yesterday the {g} came to the {place} again.", 0) for g in groups]
    for i in range(700):
        rows.append((prose(12, rng), 0))
        if i < 150:
            rows.append((f"{prose(6, rng)} {rng.choice(['zorgs', 'zorgs', 'zorgs', ''])} {rng.choice(insults)}", 1))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model, free = (toxicity.fit(docs, labels, min_gain=3.0, fairness=f) for f in (10.0, 0.0))
    assert set(groups) <= set(model.swap) and len(model.swap) == len(toxicity._SWAP) + 4 and model.pairs > 100
    neutral = pd.Series([f"the zorgs {prose(8, rng)}" for _ in range(50)])
    before, after = (free.score(neutral) >= 0.3).mean(), (model.score(neutral) >= 0.3).mean()
    assert before > 0.9 and after < 0.1
    assert (model.score(pd.Series([f"the blips, {i}" for i in insults])) >= 0.3).mean() > 0.7
    assert toxicity.swapped("Zorgs and blips. zorgs", {"zorgs": "quans", "blips": "merps"}) == ["Zorgs and merps. zorgs", "quans and blips. quans"]


def test_toxicity_of_odd_rows(spark):
    """Repeated doc_ids teach once, ties don't matter, a very long text is scored whole, columns of other names don't matter."""
    rows = [(i, "you zumpkin" if i % 2 else "a fine day", 0, "s") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 1.0) for i in range(80)] + [(1, 0, 0.0), (None, 1, 0.0), (3, None, 0.0), (5, 7, 0.0)], "doc_id long, toxic int, score double")
    fields = "doc_id long, text string, toxic int, held_out string"
    model = toxicity.fit(spark.createDataFrame(rows, fields), labels, min_gain=3.0)
    again = toxicity.fit(spark.createDataFrame(rows[::-1] * 3, fields).repartition(5), labels, min_gain=3.0)
    assert model == again and model.weights["zumpkin"] > 0
    odd = [(1, "x " * 200_000 + "zumpkin", 1, ""), (1, "x " * 200_000 + "zumpkin", 1, ""), (2, None, 1, ""), (2, "", 1, ""), (None, "zumpkin", 0, "")]
    got = sorted((r["score"], r["predicted"]) for r in toxicity.scored(spark.createDataFrame(odd, fields), model).collect())
    assert len(got) == 5 and got[0] == got[1] and got[0][1] == 0 and got[2] == got[3] == got[4] and got[4][1] == 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="page">
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div id="cookie-notice">We use cookies</div><div class='ad'>Buy</div>
<main><article><h1>Head &amp; &lt;line&gt;</h1><p>First  para<br>goes
on.<p>Second <b>bold</b> &eacute;&#233;<div class="share-buttons">Share it</div><ul><li>One<li>Two</ul><form><input><button>Go</button></form></article></main>
<aside>Side</aside><section class="comments"><p>Nice!</p></section><div class="subscribe">{}</div><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    rows = [(1, "http://a.org/1", PAGE), (2, "http://a.org/2", None), (3, None, ""), (3, None, "plain &amp; text"), (4, "http://b.org/x", "<p>open<script>x</scr"), (5, "http://b.org/y", "<div><p>a</div>b</p><!-- c -- > d"), (6, "u://c", "<p>a < b and \"c</p><p>x" + "y " * 50_000)]
    df = spark.createDataFrame([(*r, "low") for r in rows], "page_id long, url string, html string, low string")
    got = [(r["page_id"], r["text"]) for r in html_tree.extracted(df).collect()]
    want = dict(got)
    assert want[1] == "Head & <line>\n\nFirst para goes on.\n\nSecond bold éé\n\nOne\n\nTwo"
    assert want[2] == "" and sorted(t for p, t in got if p == 3) == ["", "plain & text"]
    assert want[4] == "open" and want[5].startswith("a\n\nb") and want[6].endswith("y y")
    assert html_tree.extracted(df.limit(0)).count() == 0
    assert html_tree.main_text('<form id=f><div class="layout has-sidebar"><main><p>In</main><div id="comments"><article>No</article></div></div></form>', set()) == "In"
    assert html_tree.main_text('<div class="content with-sidebar"><p>In</p><div class="sidebarLeft">No</div></div>', set()) == "In"


def test_style_trees(spark):
    page = '<html><body><div class="motto{i}">Always the same words</div><div class="story"><p>{t}</p></div></body></html>'
    rows = [(i, f"http://a.org/{i}", page.format(i=i, t=prose(20))) for i in range(12)] + [(99, "http://b.org/", page.format(i=1, t="Alone"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r["page_id"]: r["text"] for r in html_tree.extracted(df).collect()}
    assert all("Always" not in texts[i] and texts[i] for i in range(12)) and texts[99] == "Always the same words\n\nAlone"
    tree = {r["path"]: r["importance"] for r in html_tree.site_trees(df).where("host = 'a.org'").collect()}
    assert tree["html > body > div.motto"] == 0 and tree["html > body > div.story > p"] == pytest.approx(1)
    joined = html_tree.extracted(df, list_bytes=0)  # beyond what may be sent to all tasks
    assert {r["page_id"]: r["text"] for r in joined.collect()} == texts


def test_trees_find_what_sites_repeat(spark):
    """Importances equal a plain count, and with no word of the mark list in use the trees take adverts, menus and footers that rotate."""
    pages = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    at, parsed = {}, [(html_tree._host(r["url"]), html_tree.blocks(r["html"])) for r in pages]
    for host, found in parsed:
        own = "\n".join(b.text for b in found)
        for b in found:
            at.setdefault((host, " > ".join(b.path)), {}).setdefault(b.text, set()).add(own)
    want = {k: brute.importance([len(p) for p in texts.values()], len(set().union(*texts.values()))) for k, texts in at.items()}
    got = {(r["host"], r["path"]): r["importance"] for r in html_tree.site_trees(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    low, gone, stay, hosts = {}, 0, 0, {}
    for host, path in (k for k, v in got.items() if v < 0.9):
        low.setdefault(host, set()).add(path)
    for (host, found), r in zip(parsed, pages):
        hosts[host] = hosts.get(host, 0) + 1
    for (host, found), r in zip(parsed, pages):
        if hosts[host] >= 40:
            left = html_tree.main_text(r["html"], low.get(host, set()), marks=False).split("\n\n")
            assert left == html_tree.main_text(r["html"], set()).split("\n\n") or hosts[host] < 60
            stay += sum(b.marked and b.text in left for b in found)
            gone += sum(b.marked and b.text not in left for b in found)
    assert gone > 9 * stay and gone > 5000


def test_shared_text_spares_what_is_beside_it(spark):
    """A stray text under a container, or a heading that each article repeats, costs no page its own paragraphs."""
    shapes = {
        "body.org": "<body>| <p>{t}</p><div class='story'><p>{t}</p></div></body>",
        "div.org": "<body><div class='content'>Share: <p>{t}</p><div class='motto'><p>Same words</p></div></div></body>",
        "art.org": "<body><article>Credit <h2>Summary</h2><p>{t}</p><ul><li>One rule</ul><div class='motto'><p>Same words</p></div></article></body>",
    }
    rows = [(100 * k + i, f"http://{host}/{i}", shape.format(t=f"own{i} " + prose(20).replace("\n", " "))) for k, (host, shape) in enumerate(shapes.items()) for i in range(12)]
    texts = {r["page_id"]: r["text"] for r in html_tree.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert texts[i].count(f"own{i} ") == 2 and "|" not in texts[i]
        assert f"own{i} " in texts[100 + i] and "Share" not in texts[100 + i] and "Same" not in texts[100 + i]
        assert texts[200 + i].startswith(f"Credit\n\nSummary\n\nown{i} ") and texts[200 + i].endswith("One rule")


def test_small_hosts_lose_what_repeats(spark):
    """Two pages tell what a site repeats; copies of one page tell nothing, on a host of their own or among others."""
    page = "<body><div class='motto'>Same words</div><div class='story'><p>{t}</p></div></body>"
    rows = [(i, f"http://two.org/{i}", page.format(t=f"own{i}")) for i in range(2)] + [(10 + i, f"http://copy.org/{i}", page.format(t="copied")) for i in range(9)]
    rows += [(30 + i, f"http://mixed.org/{i}", page.format(t=f"own{max(i, 20)}")) for i in range(24)]
    texts = {r["page_id"]: r["text"] for r in html_tree.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert texts[0] == "own0" and texts[1] == "own1"
    assert all(texts[10 + i] == "Same words\n\ncopied" for i in range(9))
    assert all(texts[30 + i] == f"own{max(i, 20)}" for i in range(24))


def test_views_of_a_story_cost_no_article(spark):
    """Each story stands on several pages of a host, in no article element: with two views, and three; and on a host that has nothing but two views."""
    page = "<body><div class='content'><p>{t}</p></div><div class='motto'>Same words</div><div class='tail'><p>tail {i}</p></div></body>"
    rows, want = [], {}
    for views in (2, 3):
        for story in range(20):
            text = prose(60).replace("\n", " ").strip()
            for v in range(views):
                i = 1000 * views + 10 * story + v
                rows.append((i, f"http://v{views}.org/{i}", page.format(t=text, i=i)))
                want[i] = f"{text}\n\ntail {i}"
    text = prose(60).replace("\n", " ").strip()
    for i in range(2):
        rows.append((i, f"http://only.org/{i}", page.format(t=text, i=i)))
        want[i] = f"{text}\n\ntail {i}"
    got = {r["page_id"]: r["text"] for r in html_tree.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: " ".join(v.split()) for k, v in got.items()} == {k: " ".join(v.split()) for k, v in want.items()}


def test_trees_alone_take_what_no_name_tells(spark):
    """Notices that rotate among three texts, and a line that all pages share, under names that say nothing; names off or on, the trees take them."""
    page = "<body><div class='x1'><p>{n}</p></div><div class='y'><p>{t}</p><p>{u}</p></div><div class='z'>All pages say so</div></body>"
    notices = ["We use your data.", "Call us now.", "Winter sale."]
    rows = [(i, f"http://n.org/{i}", page.format(n=notices[i % 3], t=f"own{i} " + prose(20), u=f"more{i}")) for i in range(60)]
    texts = {r["page_id"]: r["text"] for r in html_tree.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(60):
        assert texts[i].startswith(f"own{i} ") and texts[i].endswith(f"more{i}") and not any(n in texts[i] for n in [*notices, "All pages"])


def test_queries_and_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert [n for n in QUERIES if re.match(r"op\d+_", n)] == list(QUERIES) and len(QUERIES) == 13
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    first = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        seen.append(docs.count())
        assert docs.columns == first.columns
    assert seen == sorted(seen, reverse=True) and seen[0] < first.count() and seen[-1] > 0.5 * first.count()
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for r in docs.collect():
        n, hit, _, _ = brute.hits(r["text"], bench)
        assert not (hit and 20 * hit >= n)
    assert {c for _, _, c in brute.simhash([(r["doc_id"], r["text"]) for r in docs.collect()])} == {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.run(spark, sf).count() > 0
