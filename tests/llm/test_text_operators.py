from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import bpe, lines, mixing, outliers, quality, spans
from tidewire.llm.queries import oracle_sql, queries, tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def odd_rows():
    long = " ".join(f"word{k % 997}" for k in range(30_000))
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "short text", None, "a", 10), (4, "short text", None, "a", 10),
        (None, "no id here", "en", None, 5), (None, None, None, None, None), (5, long, "en", "b", len(long)), (6, "a\n\n\nb \x0b c", "en", "b", 9), (7, "one " * 60, "en", "b", 1),
    ]


# Operator 2.


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return bpe.Codec(open(tokenizer_path()).read()), Tokenizer.from_file(tokenizer_path())


def test_bpe_equals_the_library(both):
    codec, own = both
    rng = random.Random(3)
    parts = ["a", "b", "'s", "'LL", "Σ", "é", "e\u0301", "İ", "ß", "ﬁ", " ", " ", "\x1c", "\x85", "\n", "1", "²", "!", "<|endoftext|>", "<|endof", "中", "👍", "the", "tion", "\u00a0", "\u200b", "K", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 30))) for _ in range(3000)] + ["", "a" * 4000, "the" * 1500, "\n"]
    for t in texts:
        want = own.encode(t, add_special_tokens=False).ids
        got = codec.encode(t)
        assert got.tolist() == want, t
        assert codec.decode(got).decode() == own.decode(want, skip_special_tokens=False)
        assert codec.decimal(got).decode() == " ".join(map(str, want))


def test_bpe_all_letters_split_as_the_library(both):
    codec, own = both
    for c in (chr(k) for k in range(0x20, 0x250)):
        for t in (c, f"a{c}b", f"{c}{c}"):
            assert codec.encode(t).tolist() == own.encode(t, add_special_tokens=False).ids, hex(ord(c))


def test_bpe_specials_of_any_look(both):
    import json

    from tokenizers import Tokenizer

    file = json.loads(open(tokenizer_path()).read())
    taken = {t["id"] for t in file.get("added_tokens", [])} | set(file["model"]["vocab"].values())
    file["added_tokens"].append({"id": max(taken) + 1, "content": "[SEP]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    own, codec = Tokenizer.from_str(json.dumps(file)), bpe.Codec(json.dumps(file))
    for t in ("a [SEP] b", "[SEP]", "[SEP", "x<|endoftext|>[SEP]y"):
        assert codec.encode(t).tolist() == own.encode(t, add_special_tokens=False).ids


def test_bpe_documents(spark, both):
    _, own = both
    rows = odd_rows()
    got = sorted(bpe.encode_documents(docs(spark, rows), tokenizer_path()).collect(), key=repr)
    want = sorted(((r[0], own.encode(r[1] or "", add_special_tokens=False).ids) for r in rows), key=lambda r: repr(r[0]))
    assert Counter((r.doc_id, tuple(r.ids), r.n_tokens) for r in got) == Counter((i, tuple(x), len(x)) for i, x in want)
    assert {(r.doc_id, r.ids_sha256) for r in got} == {(i, hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in want}
    back = bpe.decode_ids(bpe.encode_documents(docs(spark, rows), tokenizer_path()), tokenizer_path()).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, own.decode(x, skip_special_tokens=False)) for i, x in want)
    assert bpe.encode_documents(docs(spark, []), tokenizer_path()).count() == 0


# Operator 3.


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = queries()["op3_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    good, bad = np.array([r.score for r in got if r.quality == 1]), np.array([r.score for r in got if r.quality == 0])
    assert (good >= 0.3).mean() > 0.995
    assert (bad < 0.3).mean() > 0.9
    assert (good[:, None] > bad[None, :]).mean() > 0.99


def test_quality_odd_rows(spark):
    rows = odd_rows()
    labels = spark.createDataFrame([(2, 1, 0), (4, 1, 0), (5, 1, None), (None, 1, 0), (6, None, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score_documents(docs(spark, rows), labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score_documents(docs(spark, rows), labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(docs(spark, []), labels).count() == 0
    wide = docs(spark, rows).withColumns({"score": F.lit(1), "features": F.lit(2)})
    assert quality.keep_quality(wide, labels.limit(0)).columns == wide.columns


def test_prior_estimate():
    rng = np.random.default_rng(1)
    positive, unlabelled = rng.normal(2, 1, 5000), np.concatenate([rng.normal(2, 1, 8000), rng.normal(-3, 1, 2000)])
    grid = quality.thresholds(positive)
    got = quality.prior_from_tails(quality.above(positive, grid) / 5000, quality.above(unlabelled, grid) / 10_000, 5000, 10_000)
    assert abs(got - 0.8) < 0.05
    assert quality.above(np.array([1.0, 2.0, 2.0]), np.array([0.0, 2.0, 3.0])).tolist() == [3, 2, 0]


def risk(w, dp, du, prior):
    """The non-negative unbiased risk with ridge, written down as it is."""
    loss = lambda g: np.log1p(np.exp(-g))
    negative = loss(-(du @ w)).mean() - prior * loss(-(dp @ w)).mean()
    return prior * loss(dp @ w).mean() + max(0.0, negative) + (quality._decay(dp.shape[1] - 1) * w * w).sum() / 2


@pytest.mark.parametrize("prior", [0.5, 0.68, 0.72, 0.8, 0.97])
def test_risk_is_least(prior):
    """No point near or far has less risk, with a prior that is too small, too large or far too large."""
    rng = np.random.default_rng(2)
    make = lambda n, at: np.concatenate([rng.normal(at, 1, (n, 4)), np.ones((n, 1))], axis=1)
    dp, du = make(300, 1.2), np.concatenate([make(700, 1.2), make(300, -1.2)])
    w = quality.minimise_risk(dp, quality.logistic(du, -1), prior)
    least = risk(w, dp, du, prior)
    for scale in (1e-3, 1e-2, 0.1, 1.0):
        for _ in range(200):
            assert risk(w + rng.normal(0, scale, 5), dp, du, prior) > least - 2e-4


def test_parts_are_derivatives():
    rng = np.random.default_rng(5)
    z, w = rng.normal(size=(50, 4)), rng.normal(size=4)
    for sign in (1, -1):
        parts = quality.logistic(z, sign)
        _, gradient, curvature = parts(w)
        for k in range(4):
            e = np.eye(4)[k] * 1e-5
            assert abs((parts(w + e)[0] - parts(w - e)[0]) / 2e-5 - gradient[k]) < 1e-8
            assert np.allclose((parts(w + e)[1] - parts(w - e)[1]) / 2e-5, curvature[k], atol=1e-8)


def test_sums_cover_all_rows(spark):
    rows = [(k, " ".join(f"w{k % 7}{j}" for j in range(k % 40))) for k in range(300)]
    table = quality.materialise(quality.feature_table(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(23)), "t")
    want = sum(quality.features(t).astype(np.float64) for _, t in rows)
    assert np.allclose(quality._summed(table, lambda x: x.sum(axis=0, dtype=np.float64)), want)


# Operator 4.


def _counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    times = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if times[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for x in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            again += x in seen
            seen.add(x)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_counts_match_brute_force(spark):
    rng = random.Random(5)
    rows = odd_rows() + [(k, "".join(rng.choice(["a ", "b ", "cé\t", "#x\n", "\n", " \x0b"]) for _ in range(rng.randrange(120))), "en", "s", 1) for k in range(100, 160)]
    got = outliers.text_counts(docs(spark, rows)).collect()
    want = Counter((r[0], *_counts(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want


def test_outliers(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(k, text(rng.randrange(60, 600)), "en", "s" if k % 3 else None, 1) for k in range(400)]
    rows += [(1000 + k, text(200).replace(" ", "*** "), "en", "s", 1) for k in range(40)] + [(2000, text(80), "fr", "tiny", 1), (2001, None, None, None, None)]
    got = {r.doc_id: r for r in outliers.reject_outliers(docs(spark, rows).withColumns({"distance": F.lit(1), "n": F.lit(2)})).collect()}
    assert all(got[k].kept for k in range(400))
    assert not any(got[1000 + k].kept for k in range(40))
    assert got[2000].kept and got[2000].distance > 0 and got[2001].base_failed and got[2001].distance is None and not got[2001].kept
    assert outliers.reject_outliers(docs(spark, [])).count() == 0


def test_outliers_of_rare_languages(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(k, text(rng.randrange(60, 600)), "en", "s", 1) for k in range(120)] + [(200, text(200), "fr", "t", 1), (201, text(200).replace(" ", "*** "), "fr", "t", 1), (202, text(200).replace(" ", "*** "), None, None, 1)]
    got = {r.doc_id: r for r in outliers.reject_outliers(docs(spark, rows)).collect()}
    assert all(r.distance is not None for r in got.values())
    assert {k for k, r in got.items() if not r.kept} == {201, 202}


def test_least_determinant_of_several_starts(spark, monkeypatch):
    """Two clusters: the start within the tight one ends at the lesser determinant, and is the one that judges."""
    rng = np.random.default_rng(3)
    seen, plain = [], outliers.materialise
    monkeypatch.setattr(outliers, "materialise", lambda df, tag: plain(seen.append((tag, plain(df, tag))) or seen[-1][1], tag) if tag.startswith("mcd-s") else plain(df, tag))
    rows = [(k, "en", "s", int(w), int(w * 5 + rng.integers(0, w)), 0, int(rng.integers(0, 3)), 0, False) for k, w in enumerate(rng.integers(100, 3000, 600))]
    counts = outliers.materialise(spark.createDataFrame(rows, "doc_id int, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"), "counts")
    got = outliers.judge(counts).collect()
    last = [df for tag, df in seen if tag == "mcd-step"][-1].collect()
    assert {r.k for r in last} == {0, 1, 2} and all(np.isfinite(r.det) for r in last)
    for g in {r.g for r in last}:
        assert max(r.det for r in last if r.g == g) - min(r.det for r in last if r.g == g) < 1.0
    assert sum(r.kept for r in got) > 590 and all(r.distance is not None for r in got)


# Operator 6.


def line_rows():
    rng = random.Random(8)
    shared = [f"  Shared line number {k} for Everyone to see\t" for k in range(30)] + ["short", "É" * 20, "exactly twenty chars", ""]
    rows = [(k, "\n".join(rng.choice(shared) if rng.random() < 0.5 else f"own line {k} {rng.random()}" for _ in range(rng.randrange(12)))) for k in range(80)]
    return rows + [(200, None), (201, ""), (None, shared[0]), (None, shared[1]), (79, rows[79][1])]


@pytest.mark.parametrize("limit", [lines.BROADCAST_BYTES, 0])
def test_lines_match_brute_force(spark, limit):
    rows = line_rows()
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, n_lines int, high string")
    got = lines.dedup_lines(table, broadcast_bytes=limit)
    assert got.columns == ["doc_id", "text", "high", "n_lines", "n_dropped"]
    assert Counter(map(tuple, lines.digest(got).collect())) == Counter(lines.brute_force(rows))


def test_lines_on_no_rows(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_perfect_hash_holds_exactly_its_keys():
    rng = np.random.default_rng(2)
    high, low = rng.integers(-(1 << 62), 1 << 62, 20_000), rng.integers(-(1 << 62), 1 << 62, 20_000)
    high[1] = high[0]  # two keys that share the hashed half
    shard = lines.Shard(lines.build_shard(high, low, np.arange(20_000), np.arange(20_000)))
    slots = shard.find(high, low)
    assert sorted(slots) == list(range(20_000)) and (shard.keepers[slots] == np.arange(20_000)).all()
    assert (shard.find(high, low + 1) == -1).all()


# Operator 8.


def passage_rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice([". ", "! ", ".\n"])
    text = lambda: "".join(sentence(rng.randrange(1, 12)) for _ in range(rng.randrange(1, 20)))
    passages = ["".join(sentence(rng.randrange(3, 20)) for _ in range(6)), sentence(60), sentence(30) + "".join(sentence(2) for _ in range(12))]
    return [(k, text() + rng.choice(passages) * rng.randrange(3) + text()) for k in range(40)], passages


def test_spans_match_brute_force(spark):
    rows, passages = passage_rows()
    rows += [(100, None), (101, ""), (102, "x" * 50_000), (103, "a. " * 400), (104, " \n\t"), (105, ". ? x.\n\n . b!\r\nc"), (3, rows[3][1])]
    rows += [(None, passages[0] + "tail one."), (None, passages[0] + "tail two."), (7, passages[0]), (None, None)]
    got = spans.dedup_spans(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, removed string")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(spans.brute_force(rows))
    first = " ".join(passages[0].split()[2:40])
    assert sum(first in " ".join(r.text.split()) for r in got) == 1
    texts = dict(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id not in (3, 7):
            assert r.n_removed == 0 or all(0 <= s.start < s.end <= len(texts[r.doc_id]) for s in r.removed)


def test_spans_are_of_several_sentences(spark):
    lone = " ".join(f"w{k}" for k in range(40)) + "."
    short = "One two three. Four five six. Seven eight. "
    rows = [(1, f"{lone} Start of a."), (2, f"{lone} Start of b."), (3, short + "Tail a."), (4, short + "Tail b."), (5, short * 3 + lone + " End."), (6, short * 3 + lone + " Not.")]
    got = {r.doc_id: r.n_removed for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 10}
    seven = " ".join(" ".join(f"s{k}{n}" for n in range(7)) + "." for k in range(3)) + " "  # three sentences of seven words
    pair = [(1, "Before this. " + seven + "After a."), (2, "Other words. " + seven + "After b.")]
    assert {r.doc_id: r.n_removed for r in spans.dedup_spans(spark.createDataFrame(pair, "doc_id bigint, text string")).collect()} == {1: 0, 2: 3}
    few = {r.doc_id: r.n_removed for r in spans.dedup_spans(spark.createDataFrame(rows[:4], "doc_id bigint, text string"), min_sentences=3, min_words=0).collect()}
    assert few == {1: 0, 2: 0, 3: 0, 4: 3}


def test_sentences_make_up_the_text():
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice("ab.!? \n\t\u2028") for _ in range(rng.randrange(40)))
        assert "".join(spans.sentences(text)) == (text if text.strip(" \t\n\x0b\x0c\r") else "")


def test_spans_shared_ids_and_no_rows(spark):
    text = "One two three four five six seven. " * 1 + " ".join(f"w{k}" for k in range(30)) + "."
    got = spans.dedup_spans(spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {None: 0, 1: 2}  # a null id sorts first
    assert spans.dedup_spans(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# Operator 9.


def _levels(sizes, weights, budget, cap):
    """Water-filling by repetition, as the contract tells it."""
    target, open_, rest = {}, set(range(len(sizes))), budget * sum(sizes)
    while open_:
        share = {k: rest * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = {k for k in open_ if share[k] > cap * sizes[k]}
        if not over:
            return target | share
        for k in over:
            target[k] = cap * sizes[k]
            rest -= target[k]
        open_ -= over
    return target


def test_mix(spark):
    rng = random.Random(10)
    names = ["b", "a", "é", None, "B"]
    rows = [(k, " w" * rng.randrange(0, 80), "en", rng.choices(names, [60, 20, 4, 2, 1])[0], 1) for k in range(3000)] + [(None, "x y", "en", "a", 1), (5, None, "en", "a", 1)]
    table = docs(spark, rows).withColumns({"rank": F.lit(1), "target": F.lit(2), "n_docs": F.lit(0), "copies": F.lit("x")})
    mixed = mixing.mix(mixing.sized(table))
    got = mixed.collect()
    order = ["B", "a", "b", "é", None]
    sizes = [sum(r.size for r in got if r.source == s) for s in order]
    want = _levels(sizes, [3, 1, 2, 3, 1], 1.5, 2)
    for k, s in enumerate(order):
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[k]) < 1e-6 and r.source_size == sizes[k] and 0 <= r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[k]) <= 0.5
    assert Counter(map(repr, got)) == Counter(map(repr, mixing.mix(mixing.sized(table)).collect()))
    copies = mixing.training_order(mixed).collect()
    assert [c.position for c in copies] == sorted(c.position for c in copies)
    assert all(0 <= c.position <= 1 and c.words > 0 for c in copies) and sum(c.words for c in copies) == sum(r.taken for r in got)
    first_half = sum(c.words for c in copies if c.position < 0.5 and c.source == "B") / want[0]
    assert first_half >= 0.5  # the first source's schedule fades


def test_training_time_inverts_the_integral(spark):
    shares = spark.range(101).select((F.col("id") / 100).alias("q"))
    for rank, knots in enumerate(mixing.SCHEDULES, 1):
        for r in shares.select("q", mixing.training_time(F.col("q"), F.lit(rank)).alias("t")).collect():
            done = sum(
                (min(r.t, t1) - t0) * (m0 + m0 + s * (min(r.t, t1) - t0)) / 2 for t0, t1, m0, s, _ in mixing._pieces(knots) if r.t > t0
            )
            assert abs(done - r.q) < 1e-9


def test_positions_follow_the_schedule(spark):
    rng = random.Random(12)
    rows = [(k, " w" * rng.randrange(0, 50), "en", rng.choice("abc"), 1) for k in range(600)]
    sizes = mixing.sized(docs(spark, rows))
    found = {}
    for name, schedules in (("given", mixing.SCHEDULES), ("late", (((0.0, 0.0), (1.0, 1.0)),) * 3)):
        got = mixing.with_positions(mixing.mix(sizes, schedules=schedules)).collect()
        first = [r.position_1 for r in got if r.position_1 is not None]
        assert first == sorted(first) and all((r.position_1 is None) == (r.taken == 0) for r in got)
        assert all(r.position_2 is None or r.position_2 > r.position_1 for r in got)
        found[name] = {r.doc_id: (r.position_1, r.taken) for r in got}
    assert {k: v[1] for k, v in found["given"].items()} == {k: v[1] for k, v in found["late"].items()}  # a schedule moves words, and takes as many
    moved = [k for k in found["given"] if found["given"][k][0] is not None and abs(found["given"][k][0] - found["late"][k][0]) > 1e-3]
    assert len(moved) > 500


def test_training_set(spark, tmp_path):
    rng = random.Random(13)
    rows = [(k if k % 9 else None, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(0, 60))), "en", rng.choice(["a", "b", None]), k) for k in range(500)]
    rows += [(None, "same text here", "en", "a", 7)] * 150 + [(None, None, None, None, None)]
    table = docs(spark, rows).withColumns({"train_copy": F.lit("x"), "size": F.lit(-1), "tie": F.lit(0), "__text": F.lit(1)})
    table.write.parquet(f"{tmp_path}/t")
    mixed = mixing.mix(mixing.sized(docs(spark, rows))).collect()
    want = Counter()
    for r in mixed:
        want.update([(r.doc_id, r.text, r.n_chars)] * sum(2 * c.words >= r.size for c in r.copies))
    for given in (table, spark.read.parquet(f"{tmp_path}/t")):
        out = mixing.training_set(given, range_words=2_000)
        assert out.columns == [c for c in table.columns if c != "train_copy"] + ["train_position", "train_copy"]
        assert out.rdd.getNumPartitions() > 4
        got = out.collect()
        assert [r.train_position for r in got] == sorted(r.train_position for r in got)
        assert {r["size"] for r in got} == {-1}
        same = Counter((r.doc_id, r.text, r.n_chars) for r in got)
        assert sum(((same - want) + (want - same)).values()) == 0
    assert mixing.training_set(docs(spark, [])).count() == 0


def test_mix_of_nothing(spark):
    assert mixing.mix(mixing.sized(docs(spark, []))).count() == 0
    blank = mixing.mix(mixing.sized(docs(spark, [(1, "", "en", "a", 0), (2, None, "en", None, 0)]))).collect()
    assert all(r.taken == 0 and r.target == 0 and r.copies == [] for r in blank)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_its_sql(spark, sf, name):
    from tests.oracle import assert_same

    assert_same(queries()[name](spark, sf), sf, oracle_sql()[name])
