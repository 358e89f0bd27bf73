"""Operators 11 to 13: collocations, whitening, token records."""

from __future__ import annotations

import json
import random
import re
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.oracle import assert_same
from tidewire.llm import collocations, records, whitening
from tidewire.llm.queries import oracle_sql, queries, tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# Operator 11.


def phrases_by_hand(rows, least, max_words, top, covered=50):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows, phrase by phrase."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                f.setdefault(lang, Counter()).update(tuple(words[k : k + m]) for k in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = {}
        for p, a in frequent.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    inner[p[k : k + m]] = max(inner.get(p[k : k + m], 0), a)
        scored = []
        for p, a in frequent.items():
            if 100 * inner.get(p, 0) >= covered * a:
                continue
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def texts(rng, n=120):
    words = ["The", "of", "a", "Éa", "éa", "x y", "-", "(sic)", "zwölf", "中", "dog", "CAT", "tail"]
    weights = [9, 7, 5, 2, 2, 1, 1, 1, 1, 1, 2, 2, 1]
    out = []
    for _ in range(n):
        body = "".join(rng.choices(words, weights)[0] + rng.choices([" ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "!?"], [30, 3, 2, 2, 2, 1, 1, 1, 1])[0] for _ in range(rng.randrange(0, 90)))
        out.append((body, rng.choice(["en", "en", "de", None, "und"])))
    return out + [(None, "en"), ("", None), (" \t\n", "en"), ("dog dog dog dog dog dog", "en")] * 2 + [("a hot pair " * 400, "de")]


def collocated(spark, rows, **how):
    frame = spark.createDataFrame([(k, t, lang, f"w{k}", k) for k, (t, lang) in enumerate(rows)], "ids bigint, text string, lang string, word string, a bigint").repartition(5)
    return sorted(tuple(r) for r in collocations.collocations(frame, **how).collect())


@pytest.mark.parametrize("how", [{}, {"max_words": 4, "least": 5}, {"max_words": 2}, {"head": 4}, {"head": 1, "hot": 30, "partition": 200}, {"top": 3}])
def test_collocations_equal_brute_force(spark, how):
    rows = texts(random.Random(11))
    want = phrases_by_hand(rows, how.get("least", 10), how.get("max_words", 3), how.get("top", 2000))
    assert collocated(spark, rows, **how) == want and len(want) > 5


def test_collocations_of_long_texts_and_of_nothing(spark, monkeypatch):
    rng = random.Random(5)
    long = " ".join(rng.choice(["red", "blue", "sky", "sea", "of"]) for _ in range(40_000))
    monkeypatch.setattr(collocations, "SLICE", 1000)  # in this process; workers cut at their own
    assert [w for found in collocations.words_of(long.encode()) for w in found] == [w.encode() for w in long.split()]
    monkeypatch.undo()
    rows = [(long, "en"), ("word" * 50_000 + " b", "en")]
    assert collocated(spark, rows) == phrases_by_hand(rows, 10, 3, 2000)
    assert collocated(spark, [(None, None)]) == collocated(spark, [("one two three", "en")]) == []
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).collect() == []


def test_a_hot_phrase_is_dealt_to_several_partitions(spark):
    rows = [("alpha beta " * 50, "en")] * 40 + [(f"w{k % 7} w{k % 5} alpha", "en") for k in range(300)]
    assert collocated(spark, rows, hot=100, partition=300) == collocated(spark, rows) == phrases_by_hand(rows, 10, 3, 2000)


def test_words_are_cut_by_bytes_as_by_characters():
    for text in ("A\tB  c.D,e;f:g!h?i\nj\x0bk\x0cl\rm", "ÀÉ x", "\x1c\x1d  "):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        want = [[w.encode() for w in re.findall(r"[^\x20\x09]+", p)] for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]
        got, pieces = [[]], [w for found in collocations.words_of(text.encode()) for w in found]
        for w in pieces:
            if w == b"\n":
                got.append([])
            else:
                got[-1].append(w)
        assert got == want


def test_collocations_match_their_sql(spark, sf):
    assert_same(queries()["op11_collocations"](spark, sf), sf, oracle_sql()["op11_collocations"])


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9 * 10**13
    row = spark.createDataFrame([(big - 7, big, big - 3)], "a bigint, l bigint, r bigint")
    got = row.select(F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").alias("s")).first().s
    assert got == 10**6 * (big - 7) ** 2 // (big * (big - 3))


# Operator 12.


def whitened_by_hand(x, wanted=8):
    x = np.floor(np.asarray(x, float) * 1024) + 100000
    n = len(x)
    y = x - x.sum(0) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:wanted], u[:, ::-1][:, :wanted]
    deviation = [sum(int(v) ** 2 for v in n * r.astype(object) - x.astype(object).sum(0)) for r in x.astype(int)]
    return (y @ u) / np.sqrt(e), e / np.square(y).sum() * n, deviation


def check_whitened(rows, x, ids):
    want, explained, deviation = whitened_by_hand(x, min(8, x.shape[1]))
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == want.size
    for c in range(want.shape[1]):
        column = np.array([got[i, c + 1].whitened for i in ids])
        sign = np.sign(column @ want[:, c])
        assert np.allclose(column * sign, want[:, c], rtol=0, atol=1e-8)
        assert abs(got[ids[0], c + 1].explained / explained[c] - 1) < 1e-10
    assert [int(got[i, 1].deviation) for i in ids] == deviation
    assert {r.n for r in rows} == {len(x)} and max(r.identity_error for r in rows) < 1e-10


def steep(n=400, d=40, seed=2):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
    return rng.normal(size=(n, d)) * np.concatenate([3.0 ** -np.arange(9), np.full(d - 9, 1e-6)]) @ turn.T * 40


def test_the_range_finder_finds_steep_spectra_without_the_full_dimension():
    x = steep()
    y = x - x.mean(0)
    v = y.T @ y / len(x)
    calls = []

    def multiply(block):
        calls.append(block.shape[1])
        return v @ block, float(np.trace(v))

    values, vectors, trace, width = whitening.components(multiply, 40)
    e, u = np.linalg.eigh(v)
    assert width == 16 and set(calls) == {16} and len(calls) <= whitening.PASSES
    assert np.allclose(values, e[::-1][:8], rtol=1e-12) and np.allclose(np.abs(np.sum(vectors * u[:, ::-1][:, :8], axis=0)), 1, atol=1e-12)
    assert trace == np.trace(v)


def test_a_flat_spectrum_is_expanded_to_full_dimension():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 30))
    v = x.T @ x / 300
    calls = []

    def multiply(block):
        calls.append(block.shape[1])
        return v @ block, float(np.trace(v))

    values, _, _, width = whitening.components(multiply, 30)
    assert width == 30 and calls[-1] == 30 and len(calls) <= 4  # it doesn't wait for passes that won't do
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:8], rtol=1e-12)
    doubled = np.diag([5.0, 5.0, 5.0, *np.linspace(1, 2, 27)])  # equal eigenvalues never settle
    assert np.allclose(whitening.components(lambda b: (doubled @ b, float(np.trace(doubled))), 30)[0][:3], 5)


def test_whitening_equals_numpy(spark, sf):
    for x in (steep(), np.random.default_rng(4).normal(size=(200, 5))):
        ids = list(range(len(x)))
        frame = spark.createDataFrame([(k, [float(c) for c in v], 7, 1.0) for k, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>, n int, whitened double").repartition(3)
        check_whitened(whitening.whiten(frame).collect(), x, ids)
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    check_whitened(queries()["op12_whitening"](spark, sf).collect(), np.array([r.embedding for r in table], float), [r.vec_id for r in table])


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [k * 0.5, k * k * 0.1 - 1, float(k % 3)]) for k in range(6)]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [nan, 1.0, 1.0]), (54, [1.0, -inf, 1.0])]
    two = [(None, [1.0, 2.0]), (None, [3.0, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0])]
    kind = "vec_id bigint, embedding array<double>"
    rows = whitening.whiten(spark.createDataFrame(good + bad + two, kind)).collect()
    check_whitened([r for r in rows if r.n == 6], np.array([v for _, v in good]), list(range(6)))
    pairs = [r for r in rows if r.n == 4]
    assert Counter((r.vec_id, r.component) for r in pairs) == {(i, c): 2 for i in (None, 7) for c in (1, 2)}
    first = [r for r in pairs if r.component == 1]
    assert all(r.whitened is not None for r in first) and {r.whitened for r in pairs if r.component == 2} == {None}  # all on one line
    same = whitening.whiten(spark.createDataFrame([(k, [1.0, 2.0]) for k in range(3)], kind)).collect()
    assert len(same) == 6 and {(r.whitened, r.identity_error, r.explained, int(r.deviation)) for r in same} == {(None, None, None, 0)}
    assert whitening.whiten(spark.createDataFrame(bad, kind)).collect() == [] == whitening.whiten(spark.createDataFrame([], kind)).collect()
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0])], kind)).where("component = 1").collect()
    assert all(r.deviation > Decimal(2) ** 100 for r in huge) and all(abs(abs(r.whitened) - 1) < 1e-9 for r in huge)


# Operator 13.


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def crc32c_by_bits(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    crc ^= 0xFFFFFFFF
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def test_masked_checksums():
    rng = random.Random(1)
    data = [b"123456789", bytes(32), b"abcd", bytes(range(64)), bytes(range(65))] + [rng.randbytes(rng.randrange(4, 3000)) for _ in range(60)]
    assert records.masked_crc32c(data).tolist() == [crc32c_by_bits(d) for d in data]
    unmask = lambda m: (((m - 0xA282EAD8) & 0xFFFFFFFF) >> 17 | ((m - 0xA282EAD8) << 15)) & 0xFFFFFFFF
    assert unmask(int(records.masked_crc32c([b"123456789"])[0])) == 0xE3069283 and unmask(int(records.masked_crc32c([bytes(32)])[0])) == 0x8A9136AA
    framed = records.frame(data)
    assert records.unframe(framed, "x") == data
    for k in (3, 9, 20, -2):
        broken = bytearray(framed[-1])
        broken[k] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            records.unframe([*framed[:-1], bytes(broken)], "x")


def test_the_encoder_equals_the_library():
    codec, own = records.codec(open(tokenizer_path(), encoding="utf-8").read()), library()
    rng = random.Random(3)
    parts = ["the", "Tion", "'s", "'LL", "Été", "üß", "×", "÷", "1", "22", "!?", "(", " ", "  ", "\t", "\n", "\r", "\x0b", "\x1c", " ", "é", "<|endoftext|>", "<", "中", "²"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert codec.encode(t).tolist() == own.encode(t, add_special_tokens=False).ids, t


def rows_of(own, given):
    """(doc_id, start, n_tokens, crc32) in order; rows of one id by their tokens."""
    out, start = [], 0
    for i, t in sorted(given, key=lambda r: -(2**63) if r[0] is None else r[0]):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.fixture
def small_files(monkeypatch):
    monkeypatch.setattr(records, "LEAST_TEXT", 2000)


def test_records_round_trip(spark, small_files):
    rng = random.Random(8)
    given = [(k * 3 - 200, " ".join(rng.choice(["alpha", "Beta", "gamma!", "été", "x1"]) for _ in range(rng.randrange(0, 60)))) for k in range(300)]
    given += [(5000, None), (5001, ""), (5002, "word " * 30_000), (-(2**63) + 1, "low"), (2**63 - 1, "high")]
    rng.shuffle(given)
    frame = spark.createDataFrame([(i, t, "clash", 3) for i, t in given], "doc_id bigint, text string, tokens string, part int").repartition(6)
    got = records.round_trip(frame, tokenizer_path()).select("doc_id", "start", "n_tokens", F.crc32("tokens")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == rows_of(library(), given)


def test_one_id_with_many_rows_is_spread_over_files(spark, small_files, tmp_path):
    given = [(7, f"copy {k % 3} of it") for k in range(2000)] + [(None, "no id")] * 500 + [(k, "other words") for k in range(100)]
    path = f"file://{tmp_path}/set"
    frame = spark.createDataFrame(given, "doc_id bigint, text string").repartition(4)
    records.write_records(frame, path, tokenizer_path())
    files = json.loads((tmp_path / "set" / "manifest.json").read_text())["files"]
    assert len(files) > 4 and max(f["records"] for f in files) < 1000
    got = records.read_records(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in given), key=lambda i: -(2**63) if i is None else i)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    own = library()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, (*own.encode(t, add_special_tokens=False).ids, 1)) for i, t in given)
    with pytest.raises(ValueError, match="already"):
        records.write_records(frame, path, tokenizer_path())
    shuffled = records.read_records(spark, path, seed=5).collect()
    assert sorted(shuffled, key=lambda r: r.start) == got and [r.start for r in shuffled] != [r.start for r in got]
    assert shuffled == records.read_records(spark, path, seed=5).collect() != records.read_records(spark, path, seed=6).collect()
    # Damage to a data file is found, and so is damage to an index.
    for kind in ("records", "index"):
        file = tmp_path / "set" / f"{files[0]['name']}.{kind}"
        whole = file.read_bytes()
        file.write_bytes(whole[:40] + bytes([whole[40] ^ 1]) + whole[41:])
        with pytest.raises(PySparkException, match="damaged"):
            records.read_records(spark, path).collect()
        file.write_bytes(whole)
    # The files are framed as TFRecord files are.
    data = (tmp_path / "set" / f"{files[0]['name']}.records").read_bytes()
    size = int.from_bytes(data[:8], "little")
    assert int.from_bytes(data[8:12], "little") == crc32c_by_bits(data[:8]) and int.from_bytes(data[12 + size : 16 + size], "little") == crc32c_by_bits(data[12 : 12 + size])


def test_records_of_nothing_and_files_nobody_lists(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    records.write_records(spark.createDataFrame([], "doc_id bigint, text string"), path, tokenizer_path())
    assert records.read_records(spark, path).collect() == []
    records.write_records(spark.createDataFrame([(1, "a b")], "doc_id int, text string"), f"{path}2", tokenizer_path())
    (tmp_path / "set2" / "part-of-a-lost-task.records").write_bytes(b"half")
    assert [tuple(r)[:3] for r in records.read_records(spark, f"{path}2").collect()] == [(1, 0, 3)]
    with pytest.raises(ValueError, match="whole numbers"):
        records.write_records(spark.createDataFrame([("x", "a")], "doc_id string, text string"), f"{path}3", tokenizer_path())


def test_op13_equals_the_library(spark, sf):
    import duckdb

    given = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert sorted(map(tuple, queries()["op13_records"](spark, sf).collect()), key=lambda r: r[1]) == rows_of(library(), given)
