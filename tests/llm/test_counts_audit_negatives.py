"""Token counts by a digest cache, the filter audit and hard negatives against plain versions."""

import math
import random
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seamline.llm import filter_audit, hard_negatives, token_counts
from seamline.llm.filter_audit import audit, failure_masks, scan_texts
from seamline.llm.hard_negatives import hard_negatives as mine
from seamline.llm.token_counts import Counter, cached_counts, count_tokens, encode_missing, missing_texts, tokenizer_version

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# ---- token counts


@pytest.fixture(scope="module")
def counter():
    return Counter(MODEL)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁ab\n\t　é<s>/0"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_sums_over_words_are_the_library_s_counts(text):
    counter = Counter.of_worker(MODEL)
    assert counter.by_words
    assert counter.count(text) == len(counter.pieces.encode(text))


def test_counts_of_real_texts(spark, counter):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in count_tokens(docs, MODEL).collect():
        assert r.n_tokens == len(counter.pieces.encode(texts[r.doc_id])) and r.n_bytes == len(texts[r.doc_id].encode())
        assert r.over_limit == (r.n_tokens > 4096)


def test_counts_of_odd_rows(spark, counter):
    long = "word " * 300_000
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a▁b"), (None, "a b"), (None, None), (4, long), (5, "x" * 200_000), (6, " " * 1000), (7, "end ")]
    docs = spark.createDataFrame([(i, t, "q", 1, b"z") for i, t in rows], "doc_id long, text string, digest string, n_tokens int, n_bytes binary")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, MODEL).collect()), key=str)
    want = [(i, len((t or "").encode()), len(counter.pieces.encode(t or ""))) for i, t in rows]
    assert got == sorted(((*w, w[2] > 4096) for w in want), key=str)
    assert count_tokens(docs.limit(0), MODEL).collect() == []


def test_a_second_run_encodes_only_what_is_new(spark, tmp_path):
    cache, version = str(tmp_path / "cache"), tokenizer_version(MODEL)
    first = spark.createDataFrame([(1, "one text"), (2, "another text"), (3, "one text"), (4, "one▁text")], "doc_id long, text string")
    assert count_tokens(first, MODEL, cache).count() == 4
    assert cached_counts(spark, cache, version).count() == 2
    # counts that are stored are taken as they are: a planted one comes back
    planted = first.limit(1).select(F.unhex(F.sha2(F.lit("planted"), 256)).alias("digest"), F.lit(77).cast("long").alias("n_tokens"))
    planted.write.mode("append").parquet(f"{cache}/version={version}")
    second = spark.createDataFrame([(1, "planted"), (2, "one text"), (3, "a third text")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(second, MODEL, cache).collect()}
    assert got[1] == 77 and got[3] == Counter.of_worker(MODEL).encoded("a third text")
    assert cached_counts(spark, cache, version).count() == 4
    # another version shares nothing, and a digest that two runs stored counts once
    assert cached_counts(spark, cache, "other").count() == 0
    planted.write.mode("append").parquet(f"{cache}/version={version}")
    assert count_tokens(second, MODEL, cache).count() == 3


def test_a_hot_text_is_no_key_of_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "OFTEN", 20)
    docs = spark.createDataFrame([(i, "hot text" if i % 3 else f"text {i % 50}") for i in range(300)], "doc_id long, text string").repartition(4)
    out = count_tokens(docs, MODEL)
    got = {r.doc_id: r.n_tokens for r in out.collect()}
    assert len(got) == 300 and all(n == Counter.of_worker(MODEL).encoded("hot text" if i % 3 else f"text {i % 50}") for i, n in got.items())
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [0, 100])
def test_each_missing_text_is_encoded_once_either_way(spark, monkeypatch, most):
    monkeypatch.setattr(token_counts, "MAX_BROADCAST_MISSES", most)
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(200)], "doc_id long, text string").repartition(5)
    digests = docs.select(F.unhex(F.sha2("text", 256)).alias("digest")).distinct().filter(F.hex("digest") > "2")
    got = encode_missing(missing_texts(docs, digests), MODEL).collect()
    assert len(got) == len({bytes(r.digest) for r in got}) == digests.count()


# ---- filter audit


def plain_counts(text: str) -> tuple[int, ...]:
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    return len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \t\x0b\x1c\x85ABab#|é"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=8), st.integers(0, 2))
def test_scans_of_buffers_count_as_python_does(texts, skip):
    got = scan_texts(pa.array(["Left out", *texts], pa.string()).slice(min(skip, len(texts))))
    want = ["Left out", *texts][min(skip, len(texts)) :]
    assert [tuple(r) for r in got] == [plain_counts(t) for t in want]


def test_long_texts_and_shared_hashes(monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcXYZé#", k=rng.randint(1, 9))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=3000)), "", "\n".join(rng.choices(words, k=50)), "x" * 5000 + " " + "x" * 5000 + " y", " " * 3000]
    want = [plain_counts(t) for t in texts]
    for block in (64, 1000, 1 << 20):  # small blocks cut texts in pieces
        monkeypatch.setattr(filter_audit, "BLOCK", block)
        assert [tuple(r) for r in scan_texts(pa.array(texts))] == want
    monkeypatch.setattr(filter_audit, "word_hashes", lambda b, s, e: (e - s).astype(np.uint64) << np.uint64(40))
    assert [tuple(r) for r in scan_texts(pa.array(texts))] == want


def plain_audit(docs, labels):
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        w, d, c, n, s = plain_counts(t or "")
        fails = {x for x, f in zip("ABCDE", (w < 200, 100 * d < 50 * w, 100 * c > 3 * n, s > 0, i is not None and i > least[t or ""])) if f}
        rows.append((lang or "", fails, i in good, i in toxic))
    out = set()
    for part in {r[0] for r in rows}:
        mine_ = [r for r in rows if r[0] == part]
        removed = {x: 0 for x in "ABCDE"}
        table = []
        for order in permutations("ABCDE"):
            left = mine_
            for k, x in enumerate(order):
                hit = [r for r in left if x in r[1]]
                removed[x] += len(hit)
                gone = [r for r in mine_ if x in r[1] and r not in left and r[1] & set(order[:k])]
                left = [r for r in left if x not in r[1]]
                table.append((part, "".join(order), k + 1, len(left), len(hit), len(gone), sum(r[1] == {x} for r in mine_), sum(r[2] for r in hit), sum(r[3] for r in hit)))
        out |= {(*row, removed[row[1][row[2] - 1]]) for row in table}
    return out


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_of_odd_rows_against_a_plain_one(spark):
    many = " ".join(f"w{k}" for k in range(250))
    docs = [(1, many, "en"), (2, many, "en"), (2, many, "de"), (1, many, "en"), (3, None, None), (4, "", "en"), (None, many, "en"), (None, None, ""), (5, "A# b", "en"), (6, many + " #", "de"), (7, "dog " * 300, "en"), (8, "A# b", None), (9, "w " * 400_000, "en")]
    labels = [(1, 1, None), (2, 0, 1), (2, 1, 0), (7, None, 1), (None, 1, 1), (99, 1, 1)]
    d = spark.createDataFrame([(*r, "m", 0, "z") for r in docs], "doc_id long, text string, lang string, part string, bits int, good string").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r[c] for c in COLUMNS) for r in audit(failure_masks(d, table)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(docs, labels)
    assert audit(failure_masks(d.limit(0), table)).collect() == []
    assert audit(failure_masks(d, table.limit(0))).count() == 3 * 600


# ---- hard negatives


def plain_negatives(rows, every, k=5, m=3, scale=256):
    ok = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, label, tuple(math.floor(scale * float(np.float32(x))) for x in v)))
    out = []
    for i, label, v in set(r for r in ok if r[0] % every == 0):
        scored = {(sum(a * b for a, b in zip(v, w)), j, same) for j, other, w in ok if j != i for same in [other == label]}
        order = lambda x: (-x[0], x[1])
        for p, j, _ in sorted((x for x in scored if x[2]), key=order)[:k]:
            hits = sorted((x for x in scored if not x[2] and 50 * p <= 100 * x[0] <= 95 * p), key=order)[:m]
            out += [(i, j, rank + 1, x[1], p, x[0]) for rank, x in enumerate(hits)]
    return sorted(out)


FOUND = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def check(spark, rows, every=7, parts=3, **how):
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, label int, embedding array<float>, score int, id string").repartition(parts)
    got = sorted(tuple(r[c] for c in FOUND) for r in mine(table, lambda i: i % every == 0, **how).collect())
    assert got == plain_negatives(rows, every)
    return got


@pytest.mark.parametrize("size", [(1 << 14, 4096, 256), (64, 16, 4)])
def test_negatives_of_random_vectors(spark, monkeypatch, size):
    for name, x in zip(("UNIT_ROWS", "TILE_ROWS", "TILE_ANCHORS"), size):
        monkeypatch.setattr(hard_negatives, name, x)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(k, int(rng.integers(0, 4)), v[k].tolist()) for k in range(400)]
    assert check(spark, rows)
    check(spark, rows, max_anchor_bytes=8 * 8 * 10)  # several chunks of anchors


def test_negatives_of_ties_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, k % 2, [1.0, 0.5] if k % 3 else [0.7, 0.5]) for k in range(120)]  # a hot vector
    rows += [(200, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (201, 1, None), (202, 1, [1.0, None]), (203, 1, [float("nan"), 1.0]), (204, 1, [float("inf"), 1.0])]
    rows += [(210, 5, [1.0, 1.0]), (210, 5, [1.0, 1.0]), (210, 6, [0.5, 0.1]), (217, 5, [1.0]), (224, 5, []), (231, 9, [1.0, 1.0])]
    rows += [(300 + k, int(rng.integers(0, 3)), rng.normal(size=2).tolist()) for k in range(60)]
    rows += [(400 + k, 2, [-3.0, 2.0]) for k in range(20)]  # beyond unit length, and below 0
    rows += rows[:30]
    check(spark, rows)
    check(spark, rows[:3])
    assert mine(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"), lambda i: i % 2 == 0).collect() == []


def test_large_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(k, k % 3, (rng.normal(size=6) * 1e5).tolist()) for k in range(80)]
    assert check(spark, rows)
    with pytest.raises(ValueError, match="62 bits"):
        check(spark, [(0, 0, [1e30, 1.0])])
