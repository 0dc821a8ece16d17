"""Block-compressed text in ranges against plain text: ranges of any size, lines over blocks, block starts inside data, folders, and a VCF."""

import random
import struct
import zlib

import pytest

from bubblestat.sources import blocks, readers

RNG = random.Random(10)


def block(data, level=6):
    raw = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = raw.compress(data) + raw.flush()
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocked(text, size):
    return b"".join(block(text[i : i + size], RNG.choice([0, 6])) for i in range(0, len(text), size)) + block(b"")


def test_ranges(tmp_path):
    for k, (n, size) in enumerate([(1, 5), (400, 37), (300, 1000), (50, 10)]):
        lines = [("x" * RNG.randint(0, 60) + str(i)) if i % 7 else "" for i in range(n)]
        lines[0] = "first " + blocks.MAGIC.decode("latin-1")  # stored blocks hold what looks like a start
        text = "\n".join(lines) + ("\n" if k % 2 else "")
        path = tmp_path / f"{k}.gz"
        path.write_bytes(blocked(text.encode(), size))
        total = path.stat().st_size
        for split in (1, 17, 100, 999, total):
            got = [x.decode() for a in range(0, total, split) for x in blocks.lines_of(str(path), a, min(a + split, total), total)]
            assert got == (lines if k % 2 or lines[-1] else lines[:-1])


def test_spark_reads_ranges(spark, tmp_path):
    lines = [f"line {i} é" for i in range(5000)]
    (tmp_path / "d").mkdir()
    for k in range(2):
        (tmp_path / f"d/{k}.gz").write_bytes(blocked(("\n".join(lines) + "\n").encode(), 700))
    rows = blocks.read(spark, str(tmp_path / "d"), 4000)
    assert rows.rdd.getNumPartitions() > 10
    assert sorted(r[0] for r in rows.collect()) == sorted(lines * 2)
    assert blocks.read(spark, f"file://{tmp_path}/d/0.gz").count() == 5000
    assert blocks.is_blocked(str(tmp_path / "d"))
    import gzip

    (tmp_path / "plain.gz").write_bytes(gzip.compress(b"a\nb\n"))
    assert not blocks.is_blocked(str(tmp_path / "plain.gz")) and readers.text_lines(spark, str(tmp_path / "plain.gz")).count() == 2


def test_vcf(spark, tmp_path):
    names = [f"s{i}" for i in range(50)]
    head = ["##x", "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split() + names)]
    rows = ["\t".join(["c", str(i), ".", "A", "C", ".", ".", f"LV={i % 5 // 4};AT=>{i}>2,>{i}>3,>{i}>4", "GT", *[f"{RNG.choice('012.')}{RNG.choice('/|')}{RNG.choice('012.')}" + RNG.choice(["", ":7"]) for _ in names]]) for i in range(300)]
    text = "\n".join([*head, *rows]) + "\n"
    (tmp_path / "a.vcf").write_text(text)
    (tmp_path / "a.vcf.gz").write_bytes(blocked(text.encode(), 5000))
    plain, packed = str(tmp_path / "a.vcf"), str(tmp_path / "a.vcf.gz")
    want = {tuple(r) for r in readers.vcf_calls(spark, plain).collect()}
    assert want and {tuple(r) for r in readers.vcf_calls(spark, packed).collect()} == want
    assert [r["sample"] for r in readers.vcf_samples(spark, packed).orderBy("sample_idx").collect()] == names
    bits = {(r["chr"], r["path"], r["word"] * 64 + i) for r in readers.vcf_alleles(spark, packed).collect() for i in range(64) if r["bits"] >> i & 1}
    assert bits == {(r[0], r[5], r[3]) for r in want}
    (tmp_path / "b.vcf").write_text("\n".join([*head, "\t".join(["c", "1", ".", "A", "C", ".", ".", "AT=>1>2", "GT", "0"])]) + "\n")
    with pytest.raises(Exception, match="not diploid"):
        readers.vcf_alleles(spark, str(tmp_path / "b.vcf")).collect()
