"""Queries around curation: folding, gates, weighted draws, merged metrics, prompts of rows, and stored intermediates read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.functions import text as X
from seamline.functions import vectors as V
from seamline.operators import curation as C
from seamline.operators import evaluation as E
from seamline.operators import learning as L
from seamline.operators import matching as M
from seamline.operators import sampling as S
from seamline.operators.ranges import numbered
from seamline.plans.common import scratch, table
from seamline.plans.evaluation_queries import LOGITS, cm, losses, predictions, with_logits
from seamline.plans.evaluation_queries import ORACLES as SCORED
from seamline.plans.evaluation_queries import tau_sweep
from seamline.plans.text_queries import CAPTION, CLEAN, FOLD, TOKENS
from seamline.plans.vector_queries import DOT, PROMPTS, SPLIT_SQL, features, prompts, shown, split, t2t
from seamline.sources import files

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


UNIFORM = "((('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::BIGINT)::DOUBLE + 0.5) / 4294967296.0"
uniform_sql = lambda *parts: "(" + UNIFORM.format(parts=", ".join(parts)) + ")"
quote = lambda s: "'" + s.replace("'", "''") + "'"

MARKED = ["Łódź by the ő", "ệ and ǭ, ā", "ŒUVRE d'été", "Å-ström_Ÿ", "café noir", "ĐÀ NẴNG", "plain text"]
MARKED_SQL = "m(k, t) AS (VALUES " + ", ".join(f"({k}, {quote(t)})" for k, t in enumerate(MARKED)) + ")"


@query(f"WITH {MARKED_SQL} SELECT CAST(k AS INTEGER) AS k, {FOLD.format(x='t')} AS folded, array_to_string({TOKENS.format(x='t')}, ' ') AS words FROM m UNION ALL SELECT CAST(-1 - item_id AS INTEGER), {FOLD.format(x='text')}, array_to_string({TOKENS.format(x='text')}, ' ') FROM benchmark")
def fold_text(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(MARKED)), "k int, t string")
    rows = rows.union(table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).cast("int"), "text"))
    return rows.select("k", X.folded(F.col("t")).alias("folded"), F.array_join(X.tokens(F.col("t")), " ").alias("words"))


FOLDED_NAMES = ["fur", "Étè", "uber", "ça", "después", "NIÑO", "mas", "où est", "tambien", "ệ"]


@query(
    "WITH s(synonym) AS (VALUES " + ", ".join(f"({quote(n)})" for n in FOLDED_NAMES) + f"), c AS (SELECT synonym, ' ' || array_to_string({TOKENS.format(x='synonym')}, ' ') || ' ' AS phrase FROM s), "
    f"h AS (SELECT doc_id, ' ' || array_to_string({TOKENS.format(x=CAPTION.format(x='text'))}, ' ') || ' ' AS hay FROM documents) SELECT synonym, doc_id FROM h JOIN c ON contains(hay, phrase)"
)
def phrase_match_folded(spark, sf_dir):
    """Names with and without marks on their letters, in documents of several languages."""
    phrases = M.phrases_of(spark.createDataFrame([(0, n, 0, k) for k, n in enumerate(FOLDED_NAMES)], "class_id int, synonym string, cnt int, ord int"))
    return M.matches(table(spark, sf_dir, "documents"), phrases, ["doc_id"]).select("synonym", "doc_id")


@query(
    f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label, ln(list_sum(list_transform(a.x, lambda q: exp(q)))) * list_sum(b.x) - {DOT.format(a="a.x", b="b.x")} AS ce FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id),
m AS (SELECT vec_id, label, round(avg(ce), 6) AS ce FROM (SELECT a AS vec_id, label, ce FROM p UNION ALL SELECT b, label, ce FROM p) GROUP BY ALL)
SELECT label, vec_id, ce, row_number() OVER (PARTITION BY label ORDER BY ce DESC, vec_id) AS rank FROM m QUALIFY rank <= 10"""
)
def crossentropy_rank(spark, sf_dir):
    """The rows of each class with the largest mean cross-entropy to the others."""
    scored = C.mean_cross_entropy(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")).withColumn("ce", F.round("ce", 6))
    return S.sample(scored, 10, [F.desc("ce")], F.col("ce").isNotNull()).select("label", "vec_id", "ce", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY entropy DESC, vec_id) AS rank FROM ({SCORED['entropy_rank']}) QUALIFY rank <= 10")
def entropy_rank_topk(spark, sf_dir):
    """The rows of each class whose class probabilities are the most even."""
    p = V.softmax(F.transform("logits", lambda x: x["logit"]))
    scored = with_logits(spark, sf_dir).select("vec_id", "label", F.round(V.entropy(p), 6).alias("entropy"))
    return S.sample(scored, 10, [F.desc("entropy")]).select("label", "vec_id", "entropy", F.col("rank").cast("long").alias("rank"))


MEAN_SHOWN = f""", ep AS (SELECT label, unnest(ex)::DOUBLE AS v, generate_subscripts(ex, 1) AS pos FROM ex),
em AS (SELECT label, list(v ORDER BY pos) AS vec FROM (SELECT label, pos, avg(v) AS v FROM ep GROUP BY ALL) GROUP BY label),
en AS (SELECT label, list_transform(vec, lambda x: x / sqrt({DOT.format(a="vec", b="vec")})) AS vec FROM em),
ms AS (SELECT f.vec_id, f.label, round({DOT.format(a="embedding", b="vec")}, 6) AS sim2, count(*) OVER (PARTITION BY f.label) AS n FROM feats f JOIN en USING (label))
"""


@query(PROMPTS + MEAN_SHOWN + "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('5|' || vec_id), vec_id) AS rank FROM ms WHERE n >= 50 OR sim2 >= 0.2 QUALIFY rank <= 10")
def random_topk_i2i(spark, sf_dir):
    """Rows by a hash; small classes only give rows similar to the mean of the class's exemplars."""
    scored = S.mean_exemplar_score(features(spark, sf_dir), shown(spark, sf_dir), "embedding", "sim2")
    return C.gated_random(scored, 10, 50, "sim2", 0.2, 5).select("label", "vec_id", F.col("rank").cast("long").alias("rank"))


@query(PROMPTS + ", n AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rank FROM i2t WHERE true) SELECT label, vec_id, sim, rank FROM n WHERE rank <= 52 AND (n >= 52 OR sim > 0.1) AND NOT EXISTS (SELECT 1 FROM dup WHERE dup.vec_id = n.vec_id)")
def soft_filter_topk(spark, sf_dir):
    """The first places of each class without near duplicates; a class that is smaller than the cap also needs a least score."""
    scored = S.exemplar_score(features(spark, sf_dir), shown(spark, sf_dir), "caption", "sim")
    out = C.soft_filtered(scored, 52, "sim", 0.1, S.near_duplicates(table(spark, sf_dir, "embeddings"), 0.3))
    return out.select("label", "vec_id", "sim", F.col("rank").cast("long").alias("rank"))


@query(PROMPTS + "SELECT label, vec_id, sim, row_number() OVER (PARTITION BY label ORDER BY sim, vec_id) AS rank FROM t2t WHERE sim >= 0.05 QUALIFY rank <= 10")
def lowest_above_threshold(spark, sf_dir):
    return C.lowest_above(t2t(spark, sf_dir), 10, "sim", 0.05).select("label", "vec_id", "sim", F.col("rank").cast("long").alias("rank"))


@query(PROMPTS + "SELECT label, kept, removed FROM (SELECT e.label, count(*) - count(d.vec_id) AS kept, count(d.vec_id) AS removed FROM embeddings e LEFT JOIN dup d USING (label, vec_id) GROUP BY e.label) WHERE kept < removed AND kept < 100".replace("dup d", "(SELECT DISTINCT b.label, b.vec_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE " + DOT.format(a="a.embedding", b="b.embedding") + " > 0.24) d"))
def problem_classes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return C.problem_classes(e, S.near_duplicates(e, 0.24))


@query("WITH u AS (SELECT source, round(count(DISTINCT text) / count(*), 6) AS fraction FROM documents GROUP BY source) SELECT source, fraction FROM u UNION ALL SELECT 'mean', round(avg(fraction), 6) FROM u")
def unique_fraction(spark, sf_dir):
    """The share of different texts in each source, and the mean of the shares."""
    docs = table(spark, sf_dir, "documents").select("source", F.xxhash64("text").alias("h"), F.md5("text").alias("m"))
    per = docs.groupBy("source", "h", "m").agg(F.count(F.lit(1)).alias("n"), F.count("m").cast("long").alias("t"))
    per = per.groupBy("source").agg(F.round(F.count_if(F.col("t") > 0) / F.sum("n"), 6).alias("fraction"))
    return per.union(per.agg(F.lit("mean"), F.round(F.avg("fraction"), 6)))


@query(LOGITS + "SELECT round(avg(l), 6) AS loss FROM (SELECT avg(ce) AS l FROM ce GROUP BY vec_id // 32)")
def mean_batch_loss(spark, sf_dir):
    """The mean over batches of their mean loss, whatever their sizes."""
    batches = losses(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 32).alias("batch")).agg(F.avg("ce").alias("l"))
    return batches.agg(F.round(F.avg("l"), 6).alias("loss"))


@query(LOGITS + "SELECT CAST(vec_id % 4 AS VARCHAR) AS part, round(100 * avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS acc FROM pr GROUP BY ALL UNION ALL SELECT 'mean', round(avg(a), 6) FROM (SELECT round(100 * avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS a FROM pr GROUP BY vec_id % 4)")
def shifted_sets_accuracy(spark, sf_dir):
    """Accuracy on each of four sets, and their plain mean."""
    hit = (F.col("pred") == F.col("label")).cast("double")
    per = predictions(spark, sf_dir).groupBy((F.col("vec_id") % 4).cast("string").alias("part")).agg(F.round(100 * F.avg(hit), 6).alias("acc"))
    return per.union(per.agg(F.lit("mean"), F.round(F.avg("acc"), 6)))


@query("SELECT p_partkey FROM part WHERE greatest(p_size * 3, p_partkey % 150) > 80 AND least(p_size * 3, p_partkey % 150) >= 25")
def image_size_gates(spark, sf_dir):
    """Rows whose longer side is over 80 and whose shorter one has a least length."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 3).alias("w"), (F.col("p_partkey") % 150).alias("h"))
    return rows.filter((F.greatest("w", "h") > 80) & (F.least("w", "h") >= 25)).select("p_partkey")


@query("SELECT n_name, count(c_custkey) AS all_rows, count(CASE WHEN c_acctbal > 9990 THEN 1 END) AS kept, count(CASE WHEN c_acctbal > 9990 THEN 1 END) = 0 AS skipped FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def empty_class_skip(spark, sf_dir):
    """Every class with its counts; a class without rows counts 0 and is skipped."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("c_acctbal") > 9990).alias("k"))
    out = table(spark, sf_dir, "nation").join(rows, "n_nationkey", "left")
    kept = F.coalesce("k", F.lit(0))
    return out.select("n_name", F.coalesce("a", F.lit(0)).alias("all_rows"), kept.alias("kept"), (kept == 0).alias("skipped"))


@query("SELECT CAST(doc_id AS INTEGER) AS img_id, 'docs/' || doc_id || '.txt' AS filepath, toxic AS target, CASE WHEN quality = 1 THEN 'train' ELSE 'test' END AS part FROM labels")
def train_test_flag(spark, sf_dir):
    """Three files that share a key, written and read back, and the part that their flag says."""
    rows, at = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("int").alias("img_id"), "quality", "toxic"), scratch(spark)
    columns = {"images": F.concat(F.lit("docs/"), F.col("img_id").cast("string"), F.lit(".txt")), "labels": F.col("toxic"), "flags": F.col("quality")}
    for name, c in columns.items():
        rows.select("img_id", c.alias("c")).write.option("sep", " ").csv(f"{at}/{name}")
    read = files.read_keyed_triple(spark, *[f"{at}/{n}" for n in columns])
    return read.select("img_id", "filepath", "target", F.when(F.col("is_training_img") == 1, "train").otherwise("test").alias("part"))


@query("SELECT c_custkey, n_nationkey AS label FROM customer JOIN nation ON n_nationkey = c_nationkey")
def label_name_to_id(spark, sf_dir):
    """Rows that carry a label's name get its id; an unknown name would be an error."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("label"), F.col("n_name").alias("name"))
    rows = table(spark, sf_dir, "customer").join(nation.withColumnRenamed("label", "c_nationkey"), "c_nationkey").select("c_custkey", "name")
    return C.label_ids(rows, nation).select("c_custkey", "label")


FORMS = ["a photo of a {}.", "one {}", "the {} here"]


@query(
    "WITH f(k, form) AS (VALUES " + ", ".join(f"({k}, {quote(f)})" for k, f in enumerate(FORMS)) + "), "
    "p AS (SELECT n_nationkey AS label, list(replace(form, '{}', n_name) ORDER BY k) AS prompts FROM nation, f WHERE k <= n_nationkey % 3 GROUP BY ALL), "
    f"s AS (SELECT vec_id, label, CAST(floor({uniform_sql(chr(39) + '4' + chr(39), 'vec_id')} * len(prompts)) AS INTEGER) AS place, prompts FROM embeddings JOIN p USING (label)) "
    "SELECT vec_id, label, place, prompts[place + 1] AS prompt FROM s"
)
def random_prompt_of_class(spark, sf_dir):
    """Each row with one prompt of its class's own, which has one to three of them."""
    forms = spark.createDataFrame(list(enumerate(FORMS)), "k int, form string")
    nation = table(spark, sf_dir, "nation").crossJoin(F.broadcast(forms)).filter(F.col("k") <= F.col("n_nationkey") % 3)  # three forms
    made = F.struct("k", X.from_template(F.col("form"), F.col("n_name")).alias("p"))
    sets = nation.groupBy(F.col("n_nationkey").alias("label")).agg(F.array_sort(F.collect_list(made)).alias("a")).select("label", F.transform("a", lambda x: x["p"]).alias("prompts"))
    return C.own_prompts(table(spark, sf_dir, "embeddings").select("vec_id", "label"), sets, 4).select("vec_id", "label", "place", "prompt")


@query(
    LOGITS + MEAN_SHOWN
    + f""", l2 AS (SELECT e.vec_id, e.label, en.label AS c, round({DOT.format(a="e.embedding", b="en.vec")}, 6) AS logit FROM embeddings e, en),
p2 AS (SELECT vec_id, label, c AS pred FROM l2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, c) = 1),
r1 AS (SELECT label, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS stage1 FROM pr GROUP BY label),
r2 AS (SELECT label, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS stage2 FROM p2 GROUP BY label)
SELECT label, count(*) AS retrieved, any_value(stage1) AS stage1, any_value(stage2) AS stage2 FROM embeddings JOIN r1 USING (label) JOIN r2 USING (label) GROUP BY label"""
)
def counts_and_stage_scores(spark, sf_dir):
    """Class counts beside the recalls of two stages."""
    e = table(spark, sf_dir, "embeddings")
    means = V.class_means(shown(spark, sf_dir), vector="ex")
    second = E.class_scores(E.confusion(E.predicted(E.logits(e, means)))).select(F.col("class_id").alias("label"), F.col("recall").alias("stage2"))
    first = E.class_scores(cm(spark, sf_dir)).select(F.col("class_id").alias("label"), F.col("recall").alias("stage1"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("retrieved")).join(first, "label").join(second, "label")


@query("SELECT p_partkey, 'a photo of a ' || p_name || '. ' || replace('Has ' || lower(p_type), 'Has', 'has') AS prompt FROM part")
def attribute_prompt(spark, sf_dir):
    attribute = F.concat(F.lit("Has "), F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", X.with_attribute(F.lit("a photo of a {}."), F.col("p_name"), attribute).alias("prompt"))


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'images/train' ELSE 'images/val' END || '/n' || label || '_' || vec_id || '.JPEG' AS path FROM embeddings")
def path_regroup(spark, sf_dir):
    old = F.concat(F.when(F.col("vec_id") % 2 == 0, "train").otherwise("val"), F.lit("/n"), F.col("label").cast("string"), F.lit("/ILSV_x_"), F.col("vec_id").cast("string"), F.lit(".JPEG"))
    return table(spark, sf_dir, "embeddings").select("vec_id", X.regrouped_path(old, {"train": "images/train", "val": "images/val"}).alias("path"))


@query("SELECT p_partkey, 'img/' || p_partkey || '.jpg' AS path, p_name || ' of ' || p_brand AS name FROM part")
def label_line_parse(spark, sf_dir):
    line = F.concat(F.lit("img/"), F.col("p_partkey").cast("string"), F.lit(".jpg "), "p_name", F.lit(" of "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", X.path_and_name(line).alias("x")).select("p_partkey", "x.*")


@query("SELECT DISTINCT config, string_split(config, '_')[1] AS architecture, string_split(config, '_')[2] AS family, CASE WHEN len(string_split(config, '_')) > 2 THEN array_to_string(string_split(config, '_')[3:], '_') END AS pretraining FROM (SELECT lower(replace(p_name, ' ', '_')) || CASE WHEN p_size % 2 = 0 THEN '_' || lower(p_type) || '_' || p_size ELSE '' END AS config FROM part)")
def model_config_parse(spark, sf_dir):
    """Names joined by underscores, taken apart; the third part may be missing, and may hold underscores."""
    tail = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("_"), F.lower("p_type"), F.lit("_"), F.col("p_size").cast("string"))).otherwise("")
    config = F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), tail)
    return table(spark, sf_dir, "part").select(config.alias("config")).distinct().select("config", X.model_parts(F.col("config")).alias("x")).select("config", "x.*")


@query("SELECT n_name, CASE r_name WHEN 'ASIA' THEN 'Which birds live in ' || n_name || '?' WHEN 'EUROPE' THEN 'List names for ' || n_name || '.' ELSE 'What is ' || n_name || '?' END AS question FROM nation JOIN region ON r_regionkey = n_regionkey")
def question_text(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    asked = X.question(F.col("r_name"), F.col("n_name"), {"ASIA": "Which birds live in {}?", "EUROPE": "List names for {}."}, "What is {}?")
    return rows.select("n_name", asked.alias("question"))


#: A class for each brand: its name as a list has it, and its lower-cased part names with the number of parts
METRICS_SQL = "al(class_id, alternate, n) AS (SELECT p_brand, lower(p_name), count(*) FROM part GROUP BY ALL), nm(class_id, name) AS (SELECT p_brand, max(upper(p_name[1]) || p_name[2:]) FROM part GROUP BY ALL)"


def metrics(spark, sf_dir):
    """(class_id, name, alternates): metrics of the brands of the part table; a brand has few different part names."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("class_id"), "p_name")
    counts = part.groupBy("class_id", F.lower("p_name").alias("alternate")).agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("class_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("alternate", "n")))).alias("alternates"))
    names = part.groupBy("class_id").agg(F.max(F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1000))).alias("name"))
    return names.join(maps, "class_id")


def listed(classes, *more: str):
    return classes.select("class_id", *more, F.explode("alternates").alias("alternate", "n"))


EXTRA_SQL = "ex(class_id, name, others) AS (SELECT p_brand, min(upper(p_brand) || '!'), list(DISTINCT CASE WHEN p_size % 2 = 0 THEN p_type || '_' || p_size ELSE upper(p_name) END) FROM part WHERE p_size < 9 GROUP BY p_brand)"


@query(
    f"""WITH {METRICS_SQL}, {EXTRA_SQL}, w AS (SELECT class_id, unnest(list_prepend(name, others)) AS o FROM ex),
a AS (SELECT class_id, alternate, n FROM al WHERE class_id IN (SELECT class_id FROM ex) UNION ALL
  SELECT DISTINCT class_id, {CLEAN.format(x="o")}, 0 FROM w WHERE NOT EXISTS (SELECT 1 FROM al s WHERE s.class_id = w.class_id AND s.alternate = {CLEAN.format(x="o")}))
SELECT class_id, name, alternate, CAST(n AS BIGINT) AS n FROM a JOIN ex USING (class_id)"""
)
def metrics_combined(spark, sf_dir):
    small = table(spark, sf_dir, "part").filter("p_size < 9")
    other = F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit("_"), F.col("p_size").cast("string"))).otherwise(F.upper("p_name"))
    extra = small.groupBy(F.col("p_brand").alias("class_id")).agg(F.min(F.concat(F.upper("p_brand"), F.lit("!"))).alias("name"), F.collect_set(other).alias("others"))
    return listed(C.combined_metrics(metrics(spark, sf_dir), extra), "name")


@query(
    f"""WITH {METRICS_SQL}, kept AS (SELECT * FROM al WHERE n > 1) SELECT class_id, alternate, CAST(n AS BIGINT) AS n FROM kept WHERE class_id IN (SELECT class_id FROM nm) UNION ALL
SELECT class_id, {CLEAN.format(x="name")}, 0 FROM nm WHERE NOT EXISTS (SELECT 1 FROM kept s WHERE s.class_id = nm.class_id AND s.alternate = {CLEAN.format(x="nm.name")})"""
)
def official_names_back(spark, sf_dir):
    """Names that a filter of rare alternates took out are put back, at 0."""
    classes = metrics(spark, sf_dir).withColumn("alternates", F.map_filter("alternates", lambda k, n: n > 1))
    return listed(classes.withColumn("alternates", C.with_names(F.col("alternates"), F.col("name"))))


@query(f"WITH {METRICS_SQL} SELECT class_id, alternate, CAST(CASE WHEN alternate = lower(name) THEN 1 ELSE n END AS BIGINT) AS n FROM al JOIN nm USING (class_id) UNION ALL SELECT class_id, 'fresh', 7 FROM nm")
def map_upsert(spark, sf_dir):
    """Each class's own name set to 1, and a new one put in."""
    updates = F.map_from_arrays(F.array(F.lower("name"), F.lit("fresh")), F.array(F.lit(1).cast("long"), F.lit(7).cast("long")))
    return listed(metrics(spark, sf_dir).withColumn("alternates", C.upserted(F.col("alternates"), updates)))


@query("SELECT c_custkey AS class_id, CASE WHEN c_custkey % 5 = 0 THEN 'third' WHEN c_custkey % 2 = 0 THEN 'second' ELSE 'first' END AS name FROM customer")
def metrics_merge(spark, sf_dir):
    """Parts of a run one over the other."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("class_id"))
    part = lambda name, which: rows.filter(which).withColumn("name", F.lit(name))
    return C.merged_metrics(part("first", "true"), part("second", "class_id % 2 = 0"), part("third", "class_id % 5 = 0"))


@query("SELECT r_name, n_name AS alternate, CAST(0 AS BIGINT) AS n FROM nation JOIN region ON r_regionkey = n_regionkey")
def zero_counts_map(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list("n_name").alias("names"))
    return names.select("r_name", F.explode(C.zero_counts(F.concat("names", "names"))).alias("alternate", "n"))


@query("SELECT n_name, n_nationkey AS old_id, n_nationkey * 10 AS new_id FROM nation")
def inverted_map(spark, sf_dir):
    """New ids by old ones, turned around and looked up: a map as a table of pairs, so it may have any size."""
    nation = table(spark, sf_dir, "nation")
    pairs = nation.select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 10).alias("v"))
    turned = pairs.select(F.col("v").alias("new_id"), F.col("k").alias("old_id"))
    return nation.withColumn("new_id", F.col("n_nationkey") * 10).join(turned, "new_id").select("n_name", "old_id", "new_id")


@query(
    f"""WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), w AS (SELECT vec_id, CAST(1000000 // n AS BIGINT) AS w FROM embeddings JOIN n USING (label)),
l AS (SELECT vec_id, sum(w) OVER (ORDER BY vec_id) - w AS low, sum(w) OVER (ORDER BY vec_id) AS high FROM w), t AS (SELECT sum(w) AS total FROM w),
d AS (SELECT d AS draw, floor({uniform_sql("'6'", "d")} * total) AS spot FROM range(500) r(d), t)
SELECT draw, vec_id FROM d JOIN l ON spot >= low AND spot < high"""
)
def weighted_draws(spark, sf_dir):
    """Draws with replacement, rows of rare classes more often."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return C.weighted_draws(e.join(n, "label"), F.floor(F.lit(1_000_000) / F.col("n")), 500, 6)


SHARE_SQL = f"CASE WHEN {uniform_sql(chr(39) + '9' + chr(39), chr(39) + '0' + chr(39), 'vec_id')} <= 0.5 THEN {uniform_sql(chr(39) + '9' + chr(39), chr(39) + '1' + chr(39), 'vec_id')} ELSE 1.0 END"


@query(
    f"""WITH g AS (SELECT *, {SHARE_SQL} AS share, floor({uniform_sql("'group'", "vec_id")} * greatest(1, (SELECT count(*) FROM embeddings) // 4096)) AS g FROM embeddings),
o AS (SELECT *, coalesce(lead(label) OVER w, first_value(label) OVER w) AS other_label, coalesce(lead(embedding[1]) OVER w, first_value(embedding[1]) OVER w) AS head FROM g WINDOW w AS (PARTITION BY g ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id))
SELECT vec_id, label, other_label, round(share, 6) AS share, round(embedding[1]::DOUBLE * share + head::DOUBLE * (1 - share), 6) AS head FROM o"""
)
def mixup_rows(spark, sf_dir):
    """Every row mixed with another one, by a share that is drawn or 1."""
    rows = L.mixed_pairs(table(spark, sf_dir, "embeddings"), L.shares(F.col("vec_id"), seed=9))
    return rows.select("vec_id", "label", "other_label", F.round("share", 6).alias("share"), F.round(F.col("embedding")[0], 6).alias("head"))


@query(
    f"""WITH d AS (SELECT vec_id, {uniform_sql("'1'", "vec_id")} AS lam, CAST(floor({uniform_sql("'2'", "vec_id")} * 224) AS INTEGER) AS cx, CAST(floor({uniform_sql("'3'", "vec_id")} * 224) AS INTEGER) AS cy FROM embeddings),
c AS (SELECT *, floor(floor(224 * sqrt(1 - lam)) / 2) AS h FROM d),
b AS (SELECT vec_id, CAST(greatest(cx - h, 0) AS INTEGER) AS x1, CAST(greatest(cy - h, 0) AS INTEGER) AS y1, CAST(least(cx + h, 224) AS INTEGER) AS x2, CAST(least(cy + h, 224) AS INTEGER) AS y2 FROM c)
SELECT *, round(1 - (x2 - x1) * (y2 - y1) / (224.0 * 224), 6) AS kept FROM b"""
)
def cut_boxes(spark, sf_dir):
    """The boxes that are pasted over images, and the shares that are left."""
    u = lambda k: uniform_of(k)
    place = lambda k: F.floor(u(k) * 224).cast("int")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", C.cut_box(u("1"), place("2"), place("3"), 224, 224).alias("b")).select("vec_id", "b.*")
    return rows.withColumn("kept", F.round("kept", 6))


def uniform_of(k: str):
    return C.uniform(F.lit(k), F.col("vec_id"))


@query(f"SELECT CAST(tau10 AS INTEGER) AS tau10, acc FROM ({SCORED['tau_sweep']}) ORDER BY acc DESC, tau10 LIMIT 1")
def best_tau(spark, sf_dir):
    """The power of the sweep with the best accuracy; the earliest wins."""
    rows = tau_sweep(spark, sf_dir).withColumn("g", F.lit(0))
    return E.best_by(rows, ["g"], "acc", -F.col("tau10"), "tau10", "acc").drop("g")


@query("SELECT event_type, alpha, acc FROM (SELECT event_type, user_id % 11 AS alpha, round(avg(value > 50), 1) AS acc FROM (SELECT *, (value > 50)::INT::DOUBLE AS v FROM events) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY acc DESC, alpha) = 1".replace("avg(value > 50)", "avg(v)"))
def best_alpha(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 11).alias("alpha")).agg(F.round(F.avg((F.col("value") > 50).cast("double")), 1).alias("acc"))
    return E.best_by(rows, ["event_type"], "acc", -F.col("alpha"), "alpha", "acc")


@query(LOGITS + "SELECT label, pred, n FROM (SELECT *, rank() OVER (PARTITION BY label ORDER BY n DESC) AS r FROM (SELECT * FROM cm QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, pred) <= 15) WHERE label <> pred) WHERE r = 1")
def largest_confusions(spark, sf_dir):
    """Of each class's 15 largest cells the largest wrong ones, ties included."""
    few = E.top_confusions(cm(spark, sf_dir), 15).filter("label <> pred")
    return few.withColumn("r", F.rank().over(E.W.partitionBy("label").orderBy(F.desc("n")))).filter("r = 1").select("label", "pred", "n")


@query(f"WITH {METRICS_SQL} SELECT class_id, CAST(sum(n) AS BIGINT) AS freq, row_number() OVER (ORDER BY sum(n) DESC, class_id) AS place FROM al GROUP BY class_id")
def frequency_sort(spark, sf_dir):
    """Classes by the sums of their alternates' counts, the most frequent first."""
    freq = listed(metrics(spark, sf_dir)).groupBy("class_id").agg(F.sum("n").alias("freq"))
    return numbered(freq.withColumn("down", -F.col("freq")), "down", "class_id").select("class_id", "freq", (F.col("row") + 1).alias("place"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS key, row_number() OVER (ORDER BY c_nationkey) - 1 AS place FROM (SELECT DISTINCT c_nationkey FROM customer)")
def integer_key_sort(spark, sf_dir):
    """Keys that are numbers as text, in the order of the numbers."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("key")).distinct()
    return numbered(keys.withColumn("i", F.col("key").cast("int")), "i").select("key", F.col("row").alias("place"))


@query(
    f"""WITH b AS (SELECT e.vec_id, e.embedding AS x, coalesce(n.embedding, e.embedding) AS y, e.vec_id // 8 AS batch FROM embeddings e LEFT JOIN embeddings n ON n.vec_id = e.vec_id + 1),
p AS (SELECT a.batch, a.vec_id AS i, c.vec_id AS j, 10 * {DOT.format(a="a.x", b="c.y")} AS s FROM b a JOIN b c USING (batch)),
r AS (SELECT batch, i, ln(sum(exp(s))) - max(CASE WHEN i = j THEN s END) AS l FROM p GROUP BY ALL), k AS (SELECT batch, j, ln(sum(exp(s))) - max(CASE WHEN i = j THEN s END) AS l FROM p GROUP BY ALL)
SELECT batch, round((a + c) / 2, 6) AS loss FROM (SELECT batch, avg(l) AS a FROM r GROUP BY batch) JOIN (SELECT batch, avg(l) AS c FROM k GROUP BY batch) USING (batch)"""
)
def contrastive_loss(spark, sf_dir):
    rows = features(spark, sf_dir).withColumn("batch", F.floor(F.col("vec_id") / 8))
    return C.contrastive_loss(rows, "batch", scale=10.0).withColumn("loss", F.round("loss", 6))


# stored intermediates, written and read back


AUDIT = (
    PROMPTS
    + """, a AS (SELECT t2t.label, t2t.vec_id, t2t.sim, t2i.sim2, t2i.sim2 >= 0.02 AS ok FROM t2t JOIN t2i USING (vec_id)),
b AS (SELECT *, sum(ok::INT) OVER (PARTITION BY label ORDER BY sim DESC, vec_id ROWS UNBOUNDED PRECEDING) AS taken FROM a),
c AS (SELECT *, CASE WHEN ok AND taken <= 5 THEN 'sampled' WHEN NOT ok AND taken < 5 THEN 'filtered' END AS status FROM b)
SELECT status, regexp_replace(printf('%.4f', sim), '(\\.\\d+?)0+$', '\\1') || '/0.0, ' || regexp_replace(printf('%.4f', sim2), '(\\.\\d+?)0+$', '\\1') || '/0.02, mined/' || label || '/' || vec_id || '.jpg, caption ' || vec_id AS line FROM c WHERE status IS NOT NULL"""
)


@query(AUDIT)
def audit_lists(spark, sf_dir):
    """The two lists of a sampler, as lines, stored and read back."""
    both = S.prompt_score(t2t(spark, sf_dir), prompts(spark, sf_dir), "embedding", "sim2")
    rows = S.audited(both, 5, "sim", F.col("sim2") >= 0.02)
    path = F.concat_ws("/", F.lit("mined"), F.col("label").cast("string"), F.concat(F.col("vec_id").cast("string"), F.lit(".jpg")))
    text = F.concat(F.lit("caption "), F.col("vec_id").cast("string"))
    rows = rows.withColumn("line", X.audit_line(F.col("sim"), F.lit(0.0), path, text, F.col("sim2"), F.lit(0.02)))
    at = scratch(spark)
    files.write_audit(rows.select("status", "label", "sim", "vec_id", "line"), at, "T2T", "label", F.desc("sim"), "vec_id")
    read = lambda s: spark.read.text(f"{at}/T2T_{s}_list").select(F.lit(s).alias("status"), F.col("value").alias("line"))
    return read("sampled").unionByName(read("filtered"))


@query(LOGITS + "SELECT class_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1, 'aves' AS dataset, CAST(16 AS INTEGER) AS shots FROM sc")
def scores_round_trip(spark, sf_dir):
    """Scores of three runs, stored under their keys; those of one are read."""
    at, scores = scratch(spark), E.class_scores(cm(spark, sf_dir))
    for k, (dataset, shots) in enumerate((("aves", 16), ("aves", 4), ("pets", 16))):
        run = {"dataset": dataset, "method": "probe", "datasource": "fewshot", "shots": shots, "seed": 1}
        files.write_scores(scores.withColumn("recall", F.col("recall") + k), at, run, "append")
    return files.read_scores(spark, at, dataset="aves", shots=16, seed=1).select("class_id", "recall", "precision", "f1", "dataset", "shots")


@query(LOGITS + "SELECT label, pred, n FROM cm")
def confusion_round_trip(spark, sf_dir):
    at = scratch(spark)
    files.write_confusion(cm(spark, sf_dir), at)
    return spark.read.parquet(at)


@query(LOGITS + "SELECT pred, max_logit, count(*) AS n FROM pr GROUP BY ALL")
def predictions_round_trip(spark, sf_dir):
    at = scratch(spark)
    files.write_predictions(predictions(spark, sf_dir), at, "vec_id")
    return files.read_predictions(spark, at).groupBy("pred", "max_logit").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT '{' || string_agg('\"' || label || '\":' || n, ',' ORDER BY label) || '}' AS json FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def counts_json(spark, sf_dir):
    at = scratch(spark)
    files.write_counts_json(table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")), at)
    return spark.read.text(at).select(F.col("value").alias("json"))


@query("SELECT CAST(doc_id % 7 AS INTEGER) AS class_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS img_id, md5(coalesce(text, '')) AS caption FROM documents WHERE doc_id % 7 = 3")
def caption_map_round_trip(spark, sf_dir):
    """A caption map with a folder for each class, of which one is read."""
    at = scratch(spark)
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).cast("int").alias("class_id"), X.shard_name(F.col("doc_id"), 12).alias("img_id"), F.md5(F.coalesce("text", F.lit(""))).alias("caption"))
    files.write_caption_map(docs, at)
    return spark.read.schema("img_id string, caption string, class_id int").parquet(at).filter("class_id = 3").select("class_id", "img_id", "caption")


@query("SELECT 'img/' || e.vec_id AS path, e.label, round(e.embedding[1]::DOUBLE, 6) AS image, round(coalesce(n.embedding, e.embedding)[1]::DOUBLE, 6) AS caption FROM embeddings e LEFT JOIN embeddings n ON n.vec_id = e.vec_id + 1")
def feature_store_round_trip(spark, sf_dir):
    """Vectors stored in chunks and read as one table."""
    at = scratch(spark)
    rows = features(spark, sf_dir).select(F.concat(F.lit("img/"), F.col("vec_id").cast("string")).alias("path"), "label", F.col("embedding").alias("image_vec"), F.col("caption").alias("caption_vec"), "vec_id")
    for k in range(3):
        files.append_features(rows.filter(F.col("vec_id") % 3 == k), at)
    first = lambda c: F.round(F.col(c)[0].cast("double"), 6)
    return files.read_features(spark, at).select("path", "label", first("image_vec").alias("image"), first("caption_vec").alias("caption"))


@query("SELECT 'images/a b/' || vec_id || CASE WHEN vec_id % 2 = 0 THEN '.JPG' ELSE '.png' END AS path, CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END AS label, vec_id % 5 = 0 AS is_pseudo FROM embeddings")
def pseudo_label_union(spark, sf_dir):
    """Lines of labelled paths with spaces, and rows that a model labelled."""
    e = table(spark, sf_dir, "embeddings")
    path = F.concat(F.lit("images/a b/"), F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 2 == 0, ".JPG").otherwise(".png"))
    lines = e.filter("vec_id % 5 <> 0").select(F.concat(path, F.lit("  "), F.col("label").cast("string"), F.lit("\n")).alias("value"))
    return files.with_pseudo_labels(files.tagged_lines(lines), e.filter("vec_id % 5 = 0").select(path.alias("path"), (F.col("label") + 100).alias("label")))


@query(SPLIT_SQL + "SELECT value, place FROM (SELECT 'images/' || path || ' ' || label || ' ' || source AS value, row_number() OVER (ORDER BY label, md5(path)) - 1 AS place FROM both_)")
def ordered_split(spark, sf_dir):
    """A split's lines by label, each label's in the order of the input, numbered as they were stored."""
    at = scratch(spark)
    rows = split(spark, sf_dir).withColumn("h", F.md5("path")).withColumn("path", F.concat(F.lit("images/"), "path"))
    files.write_ordered_split(rows, at, "h")
    read = spark.read.text(at).withColumn("f", F.col("_metadata.file_name")).withColumn("m", F.monotonically_increasing_id())
    return numbered(read, "f", "m").select("value", F.col("row").alias("place"))


@query(PROMPTS + "SELECT label, round(vec[1], 6) AS head FROM prompts")
def prompt_cache(spark, sf_dir):
    """Class prompts made once; the second call reads what the first one stored."""
    at = scratch(spark)
    files.cached(spark, at, lambda: prompts(spark, sf_dir))

    def never():
        raise AssertionError("the cache is there")

    return files.cached(spark, at, never).select("label", F.round(F.col("vec")[0], 6).alias("head"))


@query()
def probe_round_trip(spark, sf_dir):
    """A probe stored, loaded and used."""
    from pyspark.ml.classification import LogisticRegressionModel

    e, at = table(spark, sf_dir, "embeddings"), scratch(spark)
    L.fit_probe(S.few_shot(e, 16, 1)).write().save(at)
    return L.probe(LogisticRegressionModel.load(at), e).select("vec_id", "label", "pred")


@query()
def multitask_probe(spark, sf_dir):
    """Two heads over the same vectors: the class, and whether a row is few-shot or retrieved."""
    rows = features(spark, sf_dir).withColumn("source", (F.col("vec_id") % 2).cast("int")).select("vec_id", "label", "source", "embedding")
    first = L.probe(L.fit_probe(S.few_shot(rows, 16, 1)), rows)
    return L.probe(L.fit_probe(rows, label="source"), first.withColumnRenamed("pred", "pred_label"), "source").select("vec_id", "label", "source", "pred_label", F.col("pred").alias("pred_source"))
