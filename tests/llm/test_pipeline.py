"""The pipeline over planted documents: what each stage must drop, mask or keep."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

ITEM = "the quick brown fox jumps over the lazy dog while nineteen grey herons watch quietly from frozen reeds"


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in prose(30).split()) if bad else prose(rng.randint(30, 90))))
        labels.append((i, 0 if bad else 1, 0))
    clean = {i for i in range(300) if i % 5}
    rows += [(1000, rows[1][1]), (1001, rows[2][1] + " end"), (1002, prose(40) + " " + ITEM + " " + prose(40)), (1003, prose(40) + " password=hunter22 " + prose(20))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "minhash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = dict(rows)
    texts[1003] = texts[1003].replace("password=hunter22", "<secret>")
    kept = {r.doc_id for r in packed}
    assert not kept & {1000, 1001, 1002} and 1003 in kept
    assert len(kept & clean) >= 0.98 * len(clean) and len(kept - clean - {1003}) <= 2
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i in kept:
        own = [r for r in packed if r.doc_id == i]
        assert sum(r.length for r in own) == len(plain.encode(texts[i], add_special_tokens=False).ids) + 1 == own[0].doc_tokens


def test_stages_on_odd_rows(spark, tmp_path):
    """Columns with the stages' own names stay as they are; nulls, repeats, empty and long texts, and empty tables have their results."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    bad = lambda n: " ".join(w.upper() + "!!" for w in prose(n).split())
    same, long_text = prose(50), prose(30_000)
    texts = {0: prose(40), 1: None, 2: "", 3: bad(40), 4: same, 5: same, 6: prose(30) + " " + ITEM + " " + prose(30), 7: "api_key: abcdefgh " + prose(30), 8: long_text, 9: long_text + " x"}
    rows = [(i, t) for i, t in texts.items()] + [(0, texts[0]), (None, prose(45)), (None, None)]
    clash = ("found", "score", "predicted", "kept", "component_id", "item_id", "cell", "ids", "key", "length")
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in clash)
    docs = spark.createDataFrame([(i, t, None, None, None, *[f"{c} of {i}" for c in clash]) for i, t in rows], schema)
    learned = [(100 + k, bad(30) if k % 4 == 0 else prose(rng.randint(20, 60))) for k in range(200)]
    docs = docs.union(spark.createDataFrame([(i, t, "en", "s", len(t), *clash) for i, t in learned], schema))
    at = str(tmp_path)
    spark.createDataFrame([(i, int(k % 4 > 0), 0) for k, (i, _) in enumerate(learned)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(at + "/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "")], "item_id long, text string").write.parquet(at + "/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, at)
        assert kept.schema.names == docs.schema.names, name
    found = [r for r in kept.collect() if r.doc_id is None or r.doc_id < 100]
    ids = [r.doc_id for r in found]
    assert set(ids) >= {0, 4, 7, 8} and not set(ids) & {3, 5, 6, 9}
    assert all(r[c] == f"{c} of {r.doc_id}" for r in found for c in clash)
    masked = next(r for r in found if r.doc_id == 7)
    assert masked.text.startswith("<secret> ") and masked.n_chars == len(masked.text)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), at).count() == 0, name
    packed = corpus_pipeline.packing(spark, docs.filter("doc_id < 3 or doc_id is null"), at)
    assert packed.filter("doc_id = 1").select("length").collect()[0].length == 1
