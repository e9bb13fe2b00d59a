"""Queries over embeddings: class prompts, similarity, the samplers, near duplicates and set algebra of splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions import vectors as V
from seamline.operators import sampling as S
from seamline.operators.ranges import numbered
from seamline.plans.common import table

QUERIES, ORACLES = {}, {}
K, SHOWN = 10, 4


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
PROMPTS = f"""WITH part AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
mean AS (SELECT label, pos, avg(v) AS v FROM part GROUP BY ALL),
raw AS (SELECT label, list(v ORDER BY pos) AS vec FROM mean GROUP BY label),
prompts AS (SELECT label, list_transform(vec, lambda x: x / sqrt({DOT.format(a="vec", b="vec")})) AS vec FROM raw),
feats AS (SELECT e.vec_id, e.label, e.embedding, coalesce(n.embedding, e.embedding) AS caption FROM embeddings e LEFT JOIN embeddings n ON n.vec_id = e.vec_id + 1),
ex AS (SELECT label, embedding AS ex, vec_id AS ex_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('0|' || vec_id), vec_id) AS rn FROM embeddings) WHERE rn <= {SHOWN}),
t2t AS (SELECT f.vec_id, f.label, round({DOT.format(a="caption", b="vec")}, 6) AS sim FROM feats f JOIN prompts USING (label)),
t2i AS (SELECT f.vec_id, f.label, round({DOT.format(a="embedding", b="vec")}, 6) AS sim2 FROM feats f JOIN prompts USING (label)),
exi AS (SELECT f.vec_id, f.label, round({DOT.format(a="embedding", b="ex")}, 9) AS s FROM feats f JOIN ex USING (label)),
ext AS (SELECT f.vec_id, f.label, round({DOT.format(a="caption", b="ex")}, 9) AS s FROM feats f JOIN ex USING (label)),
i2i AS (SELECT vec_id, label, round(avg(s), 6) AS sim, max(s) AS top FROM exi GROUP BY ALL),
i2t AS (SELECT vec_id, label, round(avg(s), 6) AS sim, max(s) AS top FROM ext GROUP BY ALL),
dup AS (SELECT DISTINCT b.label, b.vec_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND round({DOT.format(a="a.embedding", b="b.embedding")}, 9) > 0.3)
"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two modalities: a row's own vector, and the next row's as its caption's."""
    e = table(spark, sf_dir, "embeddings")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(following, "vec_id", "left").select("vec_id", "label", "embedding", F.coalesce("next", "embedding").alias("caption"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.class_means(table(spark, sf_dir, "embeddings"))


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.exemplars(table(spark, sf_dir, "embeddings"), SHOWN)


def ranked(scored: DataFrame, accept=None, exclude=None, k: int = K) -> DataFrame:
    out = S.sample(scored, k, [F.desc("sim")], accept, exclude)
    return out.select("label", "vec_id", "sim", F.col("rank").cast("long").alias("rank"))


def rank_sql(source: str, where: str = "true", k: int = K) -> str:
    return PROMPTS + f"SELECT label, vec_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rank FROM {source} WHERE {where}) WHERE rank <= {k}"


def t2t(spark, sf_dir):
    return S.prompt_score(features(spark, sf_dir), prompts(spark, sf_dir), "caption", "sim")


@query(rank_sql("t2t"))
def t2t_rank_topk(spark, sf_dir):
    return ranked(t2t(spark, sf_dir))


@query(PROMPTS + "SELECT label, CAST(pos AS INTEGER) AS pos, round(v, 6) AS v FROM (SELECT label, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS pos FROM prompts)")
def class_mean_prompt(spark, sf_dir):
    return prompts(spark, sf_dir).select("label", F.posexplode("vec").alias("pos", "v")).withColumn("v", F.round("v", 6))


@query(f"SELECT vec_id, round(sqrt({DOT.format(a='u', b='u')}), 6) AS length, round(u[1], 6) AS head FROM (SELECT vec_id, list_transform(w, lambda x: x / sqrt({DOT.format(a='w', b='w')})) AS u FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS w FROM embeddings))")
def vector_normalise(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.normalised(V.scaled(F.col("embedding"), F.lit(3.0))).alias("u"))
    return rows.select("vec_id", F.round(V.norm(F.col("u")), 6).alias("length"), F.round(F.col("u")[0], 6).alias("head"))


@query(PROMPTS + "SELECT label, vec_id, s AS sim, ex_id FROM (SELECT f.label, f.vec_id, ex_id, round(list_dot_product(embedding::DOUBLE[], ex::DOUBLE[]), 6) AS s FROM feats f JOIN ex USING (label))")
def pairwise_cosine(spark, sf_dir):
    """Rows against their class's exemplars, a stated and bounded set."""
    e = table(spark, sf_dir, "embeddings")
    order = F.row_number().over(S.W.partitionBy("label").orderBy(F.md5(F.concat(F.lit("0|"), F.col("vec_id").cast("string"))), "vec_id"))
    few = e.withColumn("_rn", order).filter(F.col("_rn") <= SHOWN).select("label", F.col("vec_id").alias("ex_id"), F.col("embedding").alias("ex"))
    return e.join(few, "label").select("label", "vec_id", F.round(V.dot(F.col("embedding"), F.col("ex")), 6).alias("sim"), "ex_id")


@query(rank_sql("(SELECT vec_id, label, sim2 AS sim FROM t2i)"))
def t2i_rank(spark, sf_dir):
    return ranked(S.prompt_score(features(spark, sf_dir), prompts(spark, sf_dir), "embedding", "sim"))


@query(rank_sql("i2i"))
def i2i_rank_mean(spark, sf_dir):
    return ranked(S.exemplar_score(features(spark, sf_dir), shown(spark, sf_dir), "embedding", "sim"))


@query(rank_sql("i2t"))
def i2t_rank_mean(spark, sf_dir):
    return ranked(S.exemplar_score(features(spark, sf_dir), shown(spark, sf_dir), "caption", "sim"))


@query(
    PROMPTS
    + f""", ep AS (SELECT label, unnest(ex)::DOUBLE AS v, generate_subscripts(ex, 1) AS pos FROM ex),
em AS (SELECT label, list(v ORDER BY pos) AS vec FROM (SELECT label, pos, avg(v) AS v FROM ep GROUP BY ALL) GROUP BY label),
en AS (SELECT label, list_transform(vec, lambda x: x / sqrt({DOT.format(a="vec", b="vec")})) AS vec FROM em)
SELECT label, vec_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rank
  FROM (SELECT f.vec_id, f.label, round({DOT.format(a="embedding", b="vec")}, 6) AS sim FROM feats f JOIN en USING (label))) WHERE rank <= {K}"""
)
def i2i_rank_to_mean(spark, sf_dir):
    return ranked(S.mean_exemplar_score(features(spark, sf_dir), shown(spark, sf_dir), "embedding", "sim"))


@query(rank_sql("(SELECT * FROM t2t JOIN t2i USING (vec_id, label))", "sim2 >= 0.25"))
def t2t_rank_t2i_tshd(spark, sf_dir):
    both = S.prompt_score(t2t(spark, sf_dir), prompts(spark, sf_dir), "embedding", "sim2")
    return ranked(both, F.col("sim2") >= S.IMAGE_TEXT)


@query(rank_sql("(SELECT t2t.*, round(top, 6) AS sim2 FROM t2t JOIN i2t USING (vec_id, label))", "sim2 >= 0.25"))
def t2t_rank_i2t_tshd(spark, sf_dir):
    both = S.exemplar_score(t2t(spark, sf_dir), shown(spark, sf_dir), "caption", "sim2", "max")
    return ranked(both, F.col("sim2") >= S.IMAGE_TEXT)


@query(rank_sql("(SELECT t2t.*, round(top, 6) AS sim2 FROM t2t JOIN i2i USING (vec_id, label))", "sim2 >= 0.65"))
def t2t_rank_i2i_tshd(spark, sf_dir):
    both = S.exemplar_score(t2t(spark, sf_dir), shown(spark, sf_dir), "embedding", "sim2", "max")
    return ranked(both, F.col("sim2") >= S.IMAGE_IMAGE)


@query(
    PROMPTS
    + """SELECT label, vec_id, status, printf('%.6f', sim) AS line FROM (SELECT *, CASE WHEN ok AND taken <= 5 THEN 'sampled' WHEN NOT ok AND taken < 5 THEN 'filtered' END AS status FROM
(SELECT *, sum(ok::INT) OVER (PARTITION BY label ORDER BY sim DESC, vec_id ROWS UNBOUNDED PRECEDING) AS taken FROM (SELECT t2t.*, embedding[1] >= 0 AS ok FROM t2t JOIN embeddings USING (vec_id)))) WHERE status IS NOT NULL"""
)
def sample_audit(spark, sf_dir):
    out = S.audited(t2t(spark, sf_dir), 5, "sim", F.col("embedding")[0] >= 0)
    return out.select("label", "vec_id", "status", F.format_string("%.6f", "sim").alias("line"))


@query(rank_sql("(SELECT label, vec_id, 1.0::DOUBLE AS sim, md5('3|' || vec_id) AS h FROM embeddings)").replace("ORDER BY sim DESC, vec_id) AS rank FROM (SELECT label", "ORDER BY h, vec_id) AS rank FROM (SELECT label"))
def random_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("sim", F.lit(1.0))
    out = S.sample(rows, K, [F.md5(F.concat(F.lit("3|"), F.col("vec_id").cast("string")))])
    return out.select("label", "vec_id", "sim", F.col("rank").cast("long").alias("rank"))


@query(
    PROMPTS
    + f"""SELECT label, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('3|' || vec_id), vec_id) AS rank
FROM (SELECT t2i.*, count(*) OVER (PARTITION BY label) AS n FROM t2i) WHERE n >= 50 OR sim2 >= 0.25) WHERE rank <= {K}"""
)
def random_topk_tail_head(spark, sf_dir):
    """Only classes with fewer than 50 rows keep the threshold."""
    scored = S.prompt_score(features(spark, sf_dir), prompts(spark, sf_dir), "embedding", "sim2")
    counts = scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rows = scored.join(counts, "label")
    out = S.sample(rows, K, [F.md5(F.concat(F.lit("3|"), F.col("vec_id").cast("string")))], (F.col("n") >= 50) | (F.col("sim2") >= S.IMAGE_TEXT))
    return out.select("label", "vec_id", F.col("rank").cast("long").alias("rank"))


@query(PROMPTS + "SELECT label, vec_id FROM dup")
def near_duplicates(spark, sf_dir):
    return S.near_duplicates(table(spark, sf_dir, "embeddings"), 0.3)


@query(PROMPTS + "SELECT label, round(count(d.vec_id) / count(*), 6) AS fraction FROM embeddings e LEFT JOIN dup d USING (label, vec_id) GROUP BY label UNION ALL SELECT -1, round(avg(f), 6) FROM (SELECT count(d.vec_id) / count(*) AS f FROM embeddings e LEFT JOIN dup d USING (label, vec_id) GROUP BY label)")
def dedup_fraction(spark, sf_dir):
    """The removed share of each class; label -1 has their mean."""
    e = table(spark, sf_dir, "embeddings")
    marked = e.join(S.near_duplicates(e, 0.3).withColumn("gone", F.lit(1)), ["label", "vec_id"], "left")
    per = marked.groupBy("label").agg((F.count("gone") / F.count(F.lit(1))).alias("f"))
    return per.select("label", F.round("f", 6).alias("fraction")).union(per.agg(F.lit(-1), F.round(F.avg("f"), 6)))


@query(rank_sql("(SELECT * FROM t2t WHERE NOT EXISTS (SELECT 1 FROM dup WHERE dup.vec_id = t2t.vec_id))"))
def dedup_then_rank(spark, sf_dir):
    return ranked(t2t(spark, sf_dir), exclude=S.near_duplicates(table(spark, sf_dir, "embeddings"), 0.3))


@query("SELECT label, vec_id, pick FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('1|' || vec_id), vec_id) AS pick FROM embeddings) WHERE pick <= 16")
def fewshot_sample(spark, sf_dir):
    return S.few_shot(table(spark, sf_dir, "embeddings"), 16, 1).select("label", "vec_id", F.col("pick").cast("long").alias("pick"))


SPLIT_SQL = """WITH few AS (SELECT vec_id, label, 1 AS source FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('1|' || vec_id), vec_id) AS p FROM embeddings) WHERE p <= 16),
more AS (SELECT vec_id, label, 0 AS source FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('2|' || vec_id), vec_id) AS p FROM embeddings) WHERE p <= 24),
both_ AS (SELECT 'fewshot/' || vec_id || '.jpg' AS path, label, source FROM few UNION ALL SELECT 'retrieved/' || vec_id || '.jpg', label, source FROM more)
"""


def split(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    parts = [("fewshot", S.few_shot(e, 16, 1), 1), ("retrieved", S.few_shot(e, 24, 2), 0)]
    a, b = (p.select(F.concat(F.lit(name + "/"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("path"), "label", F.lit(source).alias("source")) for name, p, source in parts)
    return a.unionByName(b)


@query(SPLIT_SQL + "SELECT path, label, source FROM both_")
def split_union(spark, sf_dir):
    return split(spark, sf_dir)


@query(SPLIT_SQL + "SELECT label, source, count(*) AS n FROM both_ GROUP BY ALL")
def split_class_counts(spark, sf_dir):
    return split(spark, sf_dir).groupBy("label", "source").agg(F.count(F.lit(1)).alias("n"))


@query(
    SPLIT_SQL
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(path), path) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM both_),
slots AS (SELECT b, s, CASE WHEN s < 9 THEN 1 ELSE 0 END AS source, CASE WHEN s < 9 THEN b * 9 + s ELSE b * 23 + s - 9 END AS place FROM range(20) t(b), range(32) u(s))
SELECT CAST(b AS INTEGER) AS batch, CAST(s AS INTEGER) AS slot, path FROM slots JOIN r ON r.source = slots.source AND r.k = place % n"""
)
def ratio_batches(spark, sf_dir):
    """20 batches of 32: 9 few-shot rows each, the rest retrieved; a part that runs out starts anew."""
    rows = split(spark, sf_dir)
    placed = numbered(rows.withColumn("h", F.md5("path")), "source", "h", "path")
    sizes = placed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("low"))  # two rows
    placed = placed.join(F.broadcast(sizes.select("source", "low")), "source").withColumn("k", F.col("row") - F.col("low"))
    slots = spark.range(20 * 32, numPartitions=1).select((F.col("id") / 32).cast("int").alias("batch"), (F.col("id") % 32).cast("int").alias("slot"))
    slots = slots.withColumn("source", F.when(F.col("slot") < 9, 1).otherwise(0)).withColumn("place", F.when(F.col("slot") < 9, F.col("batch") * 9 + F.col("slot")).otherwise(F.col("batch") * 23 + F.col("slot") - 9))
    return slots.join(F.broadcast(sizes), "source").withColumn("k", F.col("place") % F.col("n")).join(placed, ["source", "k"]).select("batch", "slot", "path")


@query("SELECT DISTINCT doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM labels WHERE quality = 1)")
def set_union(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id"), table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return a.unionByName(b).distinct()


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def set_intersect(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id"), table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return a.intersect(b)


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def set_except(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id"), table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return a.subtract(b)
