"""Token counts by a digest cache: only texts that no run has counted before are encoded, each once.

The cache is a Parquet table in a folder that all executors share, one part for each tokenizer version: (digest,
n_tokens), digest being the SHA-256 of the normalised text, the version that of the model's bytes, the library's version
and the rules below. A run joins the digests of its documents with the cache, encodes what is missing, appends it, and
takes every document's count from the cache. Digests travel, texts don't: a text is shuffled only if its digest is
missing, and copies within a task go once. Appends of two runs at a time may hold a digest twice, with the same count;
readers take one. A run that fails leaves no half row, as Spark commits its files at the end.

Normalised: a null text is empty, and the library's sign for a space (U+2581) is a space, as the library takes both for
the same. Counts are those of the sentencepiece library, without begin and end. Where no piece of the vocabulary crosses
the start of a space (proved from its pieces and on probes when the model is read), a text is the sum of its words, and
a worker remembers the counts of short words; other models encode whole texts.

Defined results: a null or empty text has 0 tokens and 0 bytes; very long texts are counted whole; bytes that are no UTF-8 count as U+FFFD; repeated rows and ids
give a row each; a null id stays null; an empty table gives an empty result and stores nothing; other columns are
dropped, whatever their names. n_bytes is that of the text as it is given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.common import shared_dir, whole, written

#: Raised whenever the rules of this module change what is stored.
RULES = "spaces-1"
SPACE = "▁"
#: Digests of so few missing texts (32 bytes each) are sent to all executors; beyond, texts and digests meet in a shuffle.
MAX_BROADCAST_MISSES = 100_000
#: Words that a worker remembers, and their longest.
MOST_WORDS, LONGEST_WORD = 1 << 18, 48
#: Rows of a digest, at least, for it to count as hot.
OFTEN = 1_000
CACHE_SCHEMA = "digest binary, n_tokens long"


class Counter:
    """Numbers of tokens by a sentencepiece model."""

    def __init__(self, model: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        self.known: dict[str, int] = {}
        # what a lone sign at a text's end costs: the library drops an input that is nothing but its own leading sign
        self.last_space = self.encoded("a ") - self.encoded("a")
        self.by_words = self._words_stand_alone()

    _of_worker: dict[str, Counter] = {}

    @classmethod
    def of_worker(cls, model: str) -> Counter:
        if model not in cls._of_worker:
            cls._of_worker[model] = cls(model)
        return cls._of_worker[model]

    def encoded(self, text: str) -> int:
        return len(self.pieces.encode(text))

    def _words_stand_alone(self) -> bool:
        """No piece has a space after something else, and the library neither squeezes nor rewrites texts."""
        names = map(self.pieces.id_to_piece, range(self.pieces.get_piece_size()))
        if any(SPACE in name.lstrip(SPACE) for name in names):
            return False
        probes = ["a  b", " a", "a ", "  ", " ", "a   b  ", " a　b", "é Ａ ﬁ", "\tx\r\n y", "<s> </s> <unk>", "1 000,5", SPACE + "a" + SPACE]
        return all(self.summed(p) == self.encoded(p) for p in probes)

    def summed(self, text: str) -> int:
        """The sum over words, each with the spaces before it."""
        if not text:
            return 0
        total, spaces, known = 0, 0, self.known
        for word in text.replace(SPACE, " ").split(" "):
            if not word:
                spaces += 1
                continue
            if spaces:
                total += self.encoded(" " * spaces + word)
                spaces = 0
                continue
            n = known.get(word)
            if n is None:
                n = self.encoded(word)
                if len(word) <= LONGEST_WORD:
                    if len(known) >= MOST_WORDS:
                        known.clear()
                    known[word] = n
            total += n
        return total + (0 if not spaces else self.last_space if spaces == 1 else self.encoded(" " * (spaces - 1)))

    def count(self, text: str) -> int:
        return self.summed(text) if self.by_words else self.encoded(text)


def tokenizer_version(model: str) -> str:
    """The digest of all that a count hangs on."""
    import sentencepiece

    with open(model, "rb") as f:
        return hashlib.sha256(b"\0".join([RULES.encode(), sentencepiece.__version__.encode(), f.read()])).hexdigest()


def normalised(text: str = "text") -> Column:
    return F.translate(whole(text), SPACE, " ")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one version, a row for each digest; none where nothing is stored yet."""
    path = f"{cache.rstrip('/')}/version={version}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the copies that a task reads, the first, packed: texts are most of what is shuffled."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    seen: set[bytes] = set()
    for batch in batches:
        digests, texts = [], []
        for digest, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if digest not in seen:
                seen.add(digest)
                digests.append(digest)
                texts.append(pack(text.as_buffer()))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(texts, pa.binary())], names=["digest", "packed"])


def missing_texts(docs: DataFrame, missing: DataFrame, text: str = "text") -> DataFrame:
    """(digest, packed) of the missing digests, dealt by digest; copies of one digest share a task. packed: the text's bytes by zstd."""
    plain = docs.select(normalised(text).alias("text")).select(_digest(F.col("text")).alias("digest"), "text")
    first = plain.mapInArrow(_first_copies, "digest binary, packed binary")
    if missing.count() <= MAX_BROADCAST_MISSES:
        return first.join(F.broadcast(missing), "digest", "left_semi").repartition("digest")
    return first.join(missing.hint("shuffle_hash"), "digest", "left_semi")


def encode_missing(texts: DataFrame, model: str) -> DataFrame:
    """(digest, n_tokens); a task encodes a digest once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counter, seen, unpack = Counter.of_worker(model), set(), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            digests, counts = [], []
            for digest, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    counts.append(counter.count(unpack(packed.as_buffer()).decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return texts.mapInArrow(run, CACHE_SCHEMA)


def new_cache(spark: SparkSession) -> str:
    """A folder for a cache of this application; give a lasting one to share counts between runs."""
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/seamline-{spark.sparkContext.applicationId}/counts-{uuid.uuid4().hex}"


def count_tokens(docs: DataFrame, model: str, cache: str | None = None, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each of docs; new counts are appended to the cache."""
    spark, version = docs.sparkSession, tokenizer_version(model)
    cache = cache or new_cache(spark)
    keyed = written(docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(whole(text)).cast("long").alias("n_bytes"), _digest(normalised(text)).alias("digest")), "digests")
    copies = written(keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "copies")
    missing = written(copies.select("digest").join(cached_counts(spark, cache, version), "digest", "left_anti"), "missing")
    if not missing.isEmpty():
        encode_missing(missing_texts(docs, missing, text), model).write.mode("append").parquet(f"{cache.rstrip('/')}/version={version}")
    counts = cached_counts(spark, cache, version)
    # digests with a thousandth of all rows or more: a thousand of them at most, so their counts are sent to every task
    often = max(OFTEN, (copies.agg(F.sum("n")).first()[0] or 0) // 1000)
    hot = written(copies.filter(F.col("n") >= often).select("digest").join(counts, "digest"), "hot")
    by_copy = keyed.join(F.broadcast(hot), "digest", "left")
    rare = by_copy.filter("n_tokens is null").drop("n_tokens").join(counts, "digest", "left")
    counted = by_copy.filter("n_tokens is not null").unionByName(rare)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
