"""Curation around the samplers: running sums, weighted draws, gates, merged class metrics and prompts of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions.text import clean_name
from seamline.functions.vectors import class_means, dot, log_sum_exp
from seamline.operators.ranges import running_sums
from seamline.operators.sampling import sample


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1 that hangs on the parts alone: the first 32 bits of their MD5."""
    head = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0


def mean_cross_entropy(features: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """features with ce: the mean of a row's cross-entropies with all other rows of its class.

    Of two rows the one with the smaller id is read as logits x, the other as targets y: lse(x) * sum(y) - x . y. The sum
    over a class splits into running sums and the class's sum vector, so no pairs are formed. Null for a single row.
    """
    x = F.transform(vector, lambda v: v.cast("double"))
    rows = features.withColumn("_l", log_sum_exp(x)).withColumn("_s", F.aggregate(x, F.lit(0.0), lambda s, v: s + v))
    rows = running_sums(rows, "label", ident, before_l=F.col("_l"), before_s=F.col("_s"), place=F.lit(1))
    after_s = F.col("before_s_all") - F.col("before_s") - F.col("_s")
    means = class_means(features, vector=vector, unit=False).withColumnRenamed("vec", "_m")
    n = F.col("place_all")
    others = n * dot(F.col(vector), F.col("_m")) - dot(F.col(vector), F.col(vector))
    ce = (F.col("_l") * after_s + F.col("_s") * F.col("before_l") - others) / F.nullif(n - 1, F.lit(0))
    return rows.join(means, "label").withColumn("ce", ce).select(*features.columns, "ce")


def weighted_draws(rows: DataFrame, weight: Column, draws: int, seed: int = 0, ident: str = "vec_id") -> DataFrame:
    """(draw, id): draws with replacement, each by its weight (whole numbers, for exact sums).

    A draw is a place on the line of running weights. The line is cut into as many buckets as there are draws, and rows
    and draws meet in buckets, so the range join is an equality with a filter.
    """
    line = running_sums(rows.withColumn("_g", F.lit(0)).withColumn("_w", weight.cast("long")).filter("_w > 0"), "_g", ident, low=F.col("_w"))
    line = line.select(ident, "low", (F.col("low") + F.col("_w")).alias("high"), F.col("low_all").alias("total"))
    width = F.ceil(F.col("total") / draws)
    spans = line.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))).select(ident, "low", "high", "bucket")
    total = line.agg(F.max("total").alias("total"))  # one row
    placed = rows.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(total)).filter("total is not null")
    placed = placed.withColumn("at", F.floor(uniform(F.lit(seed), F.col("draw")) * F.col("total"))).withColumn("bucket", F.floor(F.col("at") / width))
    return placed.join(spans, "bucket").filter("at >= low and at < high").select("draw", ident)


def gated_random(scored: DataFrame, k: int, least: int, score: str, threshold: float, seed: int = 0, ident: str = "vec_id") -> DataFrame:
    """k rows of each class by a hash; classes of fewer than `least` rows only give rows that reach the threshold."""
    sizes = scored.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    rows = scored.join(sizes, "label")
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(ident).cast("string")))
    return sample(rows, k, [order], (F.col("_n") >= least) | (F.col(score) >= threshold), ident=ident).drop("_n")


def soft_filtered(scored: DataFrame, k: int, score: str, threshold: float, exclude: DataFrame | None = None, ident: str = "vec_id") -> DataFrame:
    """Of the k best rows of each class, with rank, those that aren't excluded; a class of fewer than k rows only gives rows above the threshold.

    A place that an excluded row takes stays empty: rows beyond the k first never move up. exclude: (label, id) pairs.
    """
    sizes = scored.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    first = sample(scored.join(sizes, "label"), k, [F.desc(score)], ident=ident).filter((F.col("_n") >= k) | (F.col(score) > threshold)).drop("_n")
    return first if exclude is None else first.join(exclude.select("label", ident).distinct(), ["label", ident], "left_anti")


def lowest_above(scored: DataFrame, k: int, score: str, threshold: float, ident: str = "vec_id") -> DataFrame:
    """The k lowest rows of each class that reach the threshold."""
    return sample(scored, k, [F.asc(score)], F.col(score) >= threshold, ident=ident)


def problem_classes(rows: DataFrame, gone: DataFrame, few: int = 100, ident: str = "vec_id") -> DataFrame:
    """(label, kept, removed) of classes that lost more than they kept and kept few."""
    marked = rows.select("label", ident).join(gone.select("label", ident).distinct().withColumn("_g", F.lit(1)), ["label", ident], "left")
    per = marked.groupBy("label").agg(F.count_if(F.col("_g").isNull()).alias("kept"), F.count("_g").alias("removed"))
    return per.filter((F.col("kept") < F.col("removed")) & (F.col("kept") < few))


def with_names(alternates: Column, *names: Column) -> Column:
    """A map of alternates with cleaned names added at 0 where they are missing."""
    fresh = F.array_except(F.array_distinct(F.array(*[clean_name(n) for n in names])), F.map_keys(alternates))
    return _filled(alternates, fresh)


def _filled(alternates: Column, fresh: Column) -> Column:
    return F.map_concat(alternates, F.map_from_arrays(fresh, F.array_repeat(F.lit(0).cast("long"), F.size(fresh))))


def zero_counts(names: Column) -> Column:
    """A map of every distinct name to 0."""
    distinct = F.array_distinct(names)
    return F.map_from_arrays(distinct, F.array_repeat(F.lit(0).cast("long"), F.size(distinct)))


def combined_metrics(metrics: DataFrame, extra: DataFrame) -> DataFrame:
    """metrics with the extra table's name, and its cleaned name and alternates added at 0 where they are missing.

    extra: (class_id, name, others array of names). Every class of metrics must have a row in extra.
    """
    rows = metrics.drop("name").join(extra, "class_id")
    wanted = F.array_distinct(F.transform(F.concat(F.array("name"), "others"), lambda n: clean_name(n)))
    return rows.withColumn("alternates", _filled(F.col("alternates"), F.array_except(wanted, F.map_keys("alternates")))).drop("others")


def upserted(alternates: Column, updates: Column) -> Column:
    """A map with another map's entries put in, those of keys that are there already replaced."""
    return F.map_concat(F.map_filter(alternates, lambda k, v: ~F.map_contains_key(updates, k)), updates)


def merged_metrics(*parts: DataFrame) -> DataFrame:
    """Parts of a metrics table one over the other: of a class's rows that of the last part counts."""
    stacked = reduce(lambda a, b: a.unionByName(b), [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)])
    order = W.partitionBy("class_id").orderBy(F.desc("_part"))
    return stacked.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn", "_part")


def own_prompts(split: DataFrame, prompts: DataFrame, seed: int = 0, ident: str = "vec_id") -> DataFrame:
    """split rows with a prompt of their own class, picked evenly by a hash. prompts: (label, prompts array), a row for each class."""
    rows = split.join(prompts, "label")
    place = F.floor(uniform(F.lit(seed), F.col(ident)) * F.size("prompts")).cast("int")
    return rows.withColumn("place", place).withColumn("prompt", F.get("prompts", place)).drop("prompts")


def label_ids(rows: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """rows with label, the id of their name; a name that isn't listed is an error. names: (label, name)."""
    found = rows.join(names, name, "left")
    missing = F.raise_error(F.concat(F.lit("unknown label name: "), F.coalesce(F.col(name), F.lit("null")))).cast("int")
    return found.withColumn("label", F.coalesce(F.col("label"), missing))


def cut_box(share: Column, cx: Column, cy: Column, width: int, height: int) -> Column:
    """The box (x1, y1, x2, y2) that is pasted over an image around a centre, and the share that the image keeps."""
    cut = F.sqrt(1 - share)
    half_w, half_h = F.floor(F.floor(width * cut) / 2), F.floor(F.floor(height * cut) / 2)

    def inside(x: Column, most: int) -> Column:
        return F.least(F.greatest(x, F.lit(0)), F.lit(most)).cast("int")

    box = [inside(cx - half_w, width), inside(cy - half_h, height), inside(cx + half_w, width), inside(cy + half_h, height)]
    kept = 1 - (box[2] - box[0]) * (box[3] - box[1]) / float(width * height)
    return F.struct(*[c.alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"))], kept.alias("kept"))


def contrastive_loss(rows: DataFrame, batch: str, image: str = "embedding", text: str = "caption", scale: float = 100.0, ident: str = "vec_id") -> DataFrame:
    """(batch, loss): the symmetric contrastive loss of image and text vectors within batches, which are small by definition."""
    cells = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(ident).alias("i"), F.col(image).alias("x"), F.col(text).alias("y")))).alias("r"))

    def side(a: str, b: str) -> Column:
        one = F.transform("r", lambda p: log_sum_exp(F.transform("r", lambda q: scale * dot(p[a], q[b]))) - scale * dot(p["x"], p["y"]))
        return F.aggregate(one, F.lit(0.0), lambda s, v: s + v) / F.size("r")

    return cells.select(batch, ((side("x", "y") + side("y", "x")) / 2).alias("loss"))
