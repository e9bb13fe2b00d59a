"""Mining of captions: which class and synonym a text belongs to.

A synonym is sought by a match expression (see expressions), most often one phrase: a text holds it if the tokens stand in
it one after the other. Each text of a class is credited to one synonym only, the first in the class's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions.text import caption, clean_name, spaced_caption, unpunctuated, word_set
from seamline.operators.expressions import compiled, expression_of, holds, is_plain, lookup_key, pattern
from seamline.storage import dealt_out

#: A synonym table of more rows isn't broadcast; the token join is then an ordinary one.
MAX_BROADCAST_SYNONYMS = 200_000
#: Up to so many different keys a text's tokens are cut down to them before they become rows.
MAX_LISTED_TOKENS = 2_000


def synonyms_of(classes: DataFrame) -> DataFrame:
    """(class_id, synonym, cnt, ord) from metrics rows with a map of alternates."""
    return classes.select("class_id", F.posexplode(F.map_entries("alternates")).alias("ord", "e")).select("class_id", F.col("e.key").alias("synonym"), F.col("e.value").alias("cnt"), "ord")


def by_priority(synonyms: DataFrame) -> DataFrame:
    """synonyms with prio: a changed name first, then higher counts, then the one listed last."""
    changed = F.col("is_changed") if "is_changed" in synonyms.columns else F.lit(False)
    order = W.partitionBy("class_id").orderBy(changed.desc(), F.desc("cnt"), F.desc("ord"))
    return synonyms.withColumn("prio", F.row_number().over(order))


def phrases_of(synonyms: DataFrame, prefix: str | None = None, raw: bool = False) -> DataFrame:
    """synonyms with phrases (what a text must hold), key (a token needed anywhere), error (why a name asks nothing) and skipped.

    Names become match expressions, which are compiled; one that can't be read matches nothing and says so. Of two
    synonyms of a class that clean to the same name only the first in order is sought.
    """
    out = by_priority(synonyms).withColumn("cleaned", clean_name(F.col("synonym")))
    out = out.withColumn("_c", compiled(expression_of(F.col("synonym"), prefix, raw))).select("*", "_c.phrases", "_c.error").drop("_c")
    out = out.withColumn("skipped", F.row_number().over(W.partitionBy("class_id", "cleaned").orderBy("prio")) > 1)
    return out.withColumn("key", lookup_key(F.col("phrases")))


def _beginnings(words: Column, n: int) -> Column:
    """"*" and the first n characters of each word that has them."""
    return F.transform(words, lambda w: F.when(F.length(w) >= n, F.concat(F.lit("*"), F.substring(w, 1, n))))


def matches(captions: DataFrame, phrases: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row for each caption and synonym whose phrases it holds: keys, text (as indexed), class_id, synonym, prio.

    Captions meet synonyms over one token, so no pair is looked at that shares no token. A synonym that asks for the
    beginning of a token alone is met over the beginnings, of the lengths that are asked for.
    """
    sought = phrases.filter("not skipped and key is not null").select("class_id", "synonym", "prio", "key", "phrases")
    listed = [r[0] for r in sought.select("key").distinct().limit(MAX_LISTED_TOKENS + 1).collect()]
    lengths = sorted({len(k) - 1 for k in listed if k.startswith("*")}) if len(listed) <= MAX_LISTED_TOKENS else [r[0] for r in sought.filter(F.col("key").startswith("*")).select(F.length("key") - 1).distinct().collect()]
    if sought.limit(MAX_BROADCAST_SYNONYMS + 1).count() <= MAX_BROADCAST_SYNONYMS:
        sought = F.broadcast(sought)
    # never null, and an outer explode: no filter is inferred that would work out a text's tokens again
    texts = dealt_out(captions.select(*keys, F.col(text).alias("text"))).select(*keys, "text", F.coalesce(spaced_caption(F.col("text")), F.lit("")).alias("hay"))
    words = F.split("hay", " ")
    if lengths:
        words = F.filter(F.concat(words, *[_beginnings(words, n) for n in lengths]), lambda w: w.isNotNull())
    words = F.array_intersect(words, F.array(*[F.lit(t) for t in listed]).cast("array<string>")) if len(listed) <= MAX_LISTED_TOKENS else F.array_distinct(words)
    rows = texts.select(*keys, "text", "hay", F.explode_outer(words).alias("key"))
    one = F.get("phrases", F.lit(0))
    found = rows.join(sought.withColumns({"_one": F.when((F.size("phrases") == 1) & is_plain(one), pattern(one))}), "key")
    # most synonyms are one phrase, a plain substring
    found = found.filter(F.when(F.col("_one").isNotNull(), F.contains("hay", "_one")).otherwise(holds(F.col("hay"), F.col("phrases"))))
    return found.select(*keys, caption(F.col("text")).alias("text"), "class_id", "synonym", "prio")


def diagnostics(phrases: DataFrame) -> DataFrame:
    """(class_id, synonym, error) of synonyms that can't match as they are written: unreadable ones, and those without tokens."""
    why = F.coalesce("error", F.when(F.size("phrases") == 0, F.lit("no tokens")))
    return phrases.filter("not skipped").select("class_id", "synonym", why.alias("error")).filter("error is not null")


def attributed(found: DataFrame, keys: list[str]) -> DataFrame:
    """Of a caption's matches in a class the first by priority."""
    order = W.partitionBy("class_id", *keys).orderBy("prio")
    return found.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def synonym_counts(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """Texts for each synonym, overlaps counted for each; 0 where none; skipped ones keep their old count."""
    n = found.groupBy("class_id", "synonym").agg(F.count(F.lit(1)).alias("n"))
    out = phrases.select("class_id", "synonym", "cnt", "ord", "skipped").join(n, ["class_id", "synonym"], "left")
    return out.select("class_id", "synonym", "ord", "skipped", F.when(F.col("skipped"), F.col("cnt").cast("long")).otherwise(F.coalesce("n", F.lit(0))).alias("cnt"))


def most_common_name(names: DataFrame, counts: DataFrame, strict: bool = False) -> DataFrame:
    """(class_id, most_common_name): the top synonym if it beats the official name's count.

    Unless strict, it must not be a part of the official name: its words equal the official ones or are no subset of them.
    names: (class_id, name).
    """
    official = counts.join(names, "class_id")
    raw = F.max(F.when(F.col("synonym") == F.col("name"), F.col("cnt")))
    clean = F.max(F.when(F.col("synonym") == clean_name(F.col("name")), F.col("cnt")))
    best = F.max_by(F.struct("synonym", "cnt"), F.struct(F.col("cnt"), -F.col("ord")))
    per = official.groupBy("class_id", "name").agg(F.coalesce(raw, clean, F.lit(0)).alias("own"), best.alias("top"))

    def words(x: Column) -> Column:
        return word_set(unpunctuated(clean_name(x)))

    a, b = words(F.col("top.synonym")), words(F.col("name"))
    allowed = F.lit(True) if strict else (a == b) | (F.size(F.array_except(a, b)) > 0)
    return per.select("class_id", F.when((F.col("top.cnt") > F.col("own")) & allowed, F.col("top.synonym")).otherwise(F.col("name")).alias("most_common_name"))


def download_sample(mined: DataFrame, how: str, keys: list[str], k: int = 2000, few: int = 5, seed: int = 0, score: str | None = None) -> DataFrame:
    """mined rows chosen for download in each class: all, random, few or ranked (by a score, highest first)."""
    if how == "all":
        return mined
    ident = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys])
    first = {"random": [F.md5(ident)], "few": [], "ranked": [F.desc(score)] if score else []}[how]
    order = W.partitionBy("class_id").orderBy(*first, *keys)
    return mined.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= (few if how == "few" else k)).drop("_rn")
