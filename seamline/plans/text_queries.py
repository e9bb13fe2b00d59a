"""Queries over texts: cleaning, phrase matching, mining and its counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions import text as X
from seamline.operators import matching as M
from seamline.operators import positional_index as I
from seamline.plans.common import scratch, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: class, official name, and synonyms with their old counts in the order listed
CLASSES = [
    (0, "of the", [("of the", 120), ("the of", 80), ("OF_THE", 5)]),
    (1, "and", [("and", 300), ("and the", 300), ("'the' and", 7)]),
    (2, "of the re", [("is in", 10), ("le les", 20), ("the re", 3)]),
    (3, "der die", [("der die", 7), ("u. ber", 0), ("de/la", 2)]),
    (4, "nothing like it", [("nothing like it", 9)]),
]
SYNONYM_ROWS = [(c, s, n, k) for c, _, names in CLASSES for k, (s, n) in enumerate(names)]
_quote = lambda s: "'" + s.replace("'", "''") + "'"
SYN_SQL = "syn(class_id, synonym, cnt, ord) AS (VALUES " + ", ".join(f"({c}, {_quote(s)}, {n}, {k})" for c, s, n, k in SYNONYM_ROWS) + ")"
NAME_SQL = "names(class_id, name) AS (VALUES " + ", ".join(f"({c}, {_quote(n)})" for c, n, _ in CLASSES) + ")"
SPELL = "translate(translate({x}, '''\"', ''), '-_', '  ')"
CLEAN = "lower(replace(" + SPELL.format(x="regexp_replace({x}, '^\\s+|\\s+$', '', 'g')") + ", '  ', ' '))"
CAPTION = "CASE WHEN coalesce({x}, '') = '' THEN 'N.A.' ELSE " + SPELL + " END"
FOLD = f"translate(lower({{x}}), '{X.MARKED}', '{X.PLAIN}')"
TOKENS = "list_filter(regexp_split_to_array(" + FOLD + ", '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
WORDS = "list_sort(list_distinct(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')))"
BARE = "regexp_replace({x}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g')"


def phrase_sql(prefix: str | None = None) -> str:
    """CTEs up to found(doc_id, text, class_id, synonym, prio)."""
    words = TOKENS.format(x=f"CASE WHEN quoted THEN '{prefix} ' || cleaned ELSE cleaned END" if prefix else "cleaned")
    extra = f"CASE WHEN quoted THEN NULL ELSE '{prefix}' END" if prefix else "NULL"
    return f"""WITH {SYN_SQL},
pr AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY cnt DESC, ord DESC) AS prio, {CLEAN.format(x="synonym")} AS cleaned FROM syn),
pq AS (SELECT *, contains(cleaned, '.') OR contains(cleaned, '/') AS quoted,
  row_number() OVER (PARTITION BY class_id, cleaned ORDER BY prio) > 1 AS skipped FROM pr),
ph AS (SELECT *, ' ' || array_to_string({words}, ' ') || ' ' AS phrase, {extra} AS extra FROM pq),
dt AS (SELECT doc_id, {CAPTION.format(x="text")} AS text FROM documents),
dh AS (SELECT *, ' ' || array_to_string({TOKENS.format(x="text")}, ' ') || ' ' AS hay FROM dt),
found AS (SELECT doc_id, text, class_id, synonym, prio FROM dh JOIN ph ON NOT skipped AND contains(hay, phrase)
  AND (extra IS NULL OR contains(hay, ' ' || extra || ' ')))
"""


MINED = "mined AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class_id, doc_id ORDER BY prio) AS rn FROM found) WHERE rn = 1)"
COUNTS = """counts AS (SELECT ph.class_id, ph.synonym, ph.ord, ph.skipped, CAST(CASE WHEN ph.skipped THEN ph.cnt ELSE coalesce(n, 0) END AS BIGINT) AS cnt
  FROM ph LEFT JOIN (SELECT class_id, synonym, count(*) AS n FROM found GROUP BY ALL) f ON f.class_id = ph.class_id AND f.synonym = ph.synonym)"""


def synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYNONYM_ROWS, "class_id int, synonym string, cnt int, ord int")


def found_in_documents(spark: SparkSession, sf_dir: str, prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    phrases = M.phrases_of(synonyms(spark), prefix)
    return M.matches(table(spark, sf_dir, "documents"), phrases, ["doc_id"]), phrases


@query(f"SELECT p_partkey, {CLEAN.format(x='p_name')} AS cleaned, {CLEAN.format(x=chr(39) + ' ' + chr(39) + ' || p_brand || ' + chr(39) + '-' + chr(39) + ' || p_type')} AS odd FROM part")
def clean_text(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", X.clean_name(F.col("p_name")).alias("cleaned"), X.clean_name(F.concat(F.lit(" "), "p_brand", F.lit("-"), "p_type")).alias("odd"))


@query(f"SELECT doc_id, {CAPTION.format(x='text')} AS caption FROM documents")
def caption_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.caption(F.col("text")).alias("caption"))


@query(f"SELECT item_id, array_to_string({WORDS.format(x=BARE.format(x=CLEAN.format(x='text')))}, ' ') AS words FROM benchmark")
def strip_punct_wordset(spark, sf_dir):
    words = X.word_set(X.unpunctuated(X.clean_name(F.col("text"))))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(words, " ").alias("words"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {TOKENS.format(x='text')} AS t FROM documents)")
def tokenise(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(
    r"""SELECT p_partkey, CAST(k AS INTEGER) AS place,
  lower(translate(translate(regexp_replace(regexp_replace(replace(line, k || '.', ''), '\([^)]*\)|\[.*?\]', '', 'g'), '^\s+|\s+$', '', 'g'), '''"', ''), '-_', '  ')) AS entry
FROM (SELECT p_partkey, unnest(string_split('1. ' || p_name || ' (' || p_brand || ')' || chr(10) || '2. ' || p_type || ' [x-1]' || chr(10) || '3. ' || p_brand || '-' || p_size, chr(10))) AS line, generate_subscripts(string_split(p_name || chr(10) || chr(10), chr(10)), 1) AS k FROM part)"""
)
def numbered_list_parse(spark, sf_dir):
    listed = F.concat(F.lit("1. "), "p_name", F.lit(" ("), "p_brand", F.lit(")\n2. "), "p_type", F.lit(" [x-1]\n3. "), "p_brand", F.lit("-"), F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(X.numbered_entries(listed)).alias("e"))
    return rows.select("p_partkey", "e.place", "e.entry")


@query(r"SELECT conv_id, turn, regexp_replace('(' || role || ') ' || text || ' [' || turn || ']', '\([^)]*\)|\[.*?\]', '', 'g') AS bare FROM conversations")
def clean_brackets(spark, sf_dir):
    text = F.concat(F.lit("("), "role", F.lit(") "), "text", F.lit(" ["), F.col("turn").cast("string"), F.lit("]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.unbracketed(text).alias("bare"))


@query("SELECT page_id, string_split(url, '/')[-2] AS parent, string_split(string_split(url, '/')[-1], '.')[1] AS stem FROM pages")
def path_decompose(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.parent_name(F.col("url")).alias("parent"), X.stem(F.col("url")).alias("stem"))


@query("SELECT vec_id, lpad(CAST(vec_id % 128 AS VARCHAR), 5, '0') AS shard, lpad(CAST(vec_id AS VARCHAR), 12, '0') AS file FROM embeddings")
def zero_pad_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", X.shard_name(F.col("vec_id") % 128).alias("shard"), X.shard_name(F.col("vec_id"), 12).alias("file"))


@query(
    """WITH t AS (SELECT DISTINCT n_nationkey AS template_id, CASE n_nationkey % 3 WHEN 0 THEN 'a photo of a {} from ' || n_name || '.' WHEN 1 THEN n_name || ': a {} photo of the {}.' ELSE 'no place in ' || n_name END AS template FROM nation),
n AS (SELECT DISTINCT p_name, p_brand FROM part)
SELECT p_name, p_brand, template_id, CASE template_id % 3 WHEN 0 THEN replace(template, '{}', p_name) WHEN 1 THEN string_split(template, '{}')[1] || p_name || string_split(template, '{}')[2] || p_brand || string_split(template, '{}')[3] ELSE template END AS prompt FROM n, t"""
)
def prompt_expand(spark, sf_dir):
    """Every name in every template of a table of templates, a small dimension by definition."""
    k = F.col("n_nationkey") % 3
    said = F.when(k == 0, F.concat(F.lit("a photo of a {} from "), "n_name", F.lit("."))).when(k == 1, F.concat("n_name", F.lit(": a {} photo of the {}."))).otherwise(F.concat(F.lit("no place in "), "n_name"))
    templates = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("template_id"), said.alias("template"))
    names = table(spark, sf_dir, "part").select("p_name", "p_brand").distinct()
    return names.crossJoin(F.broadcast(templates)).select("p_name", "p_brand", "template_id", X.from_template(F.col("template"), F.col("p_name"), F.col("p_brand")).alias("prompt"))


@query("SELECT event_id, lower(event_type) IN ('t', 'yes', 'click') AS is_click, (user_id % 2) = 1 AS odd FROM events")
def boolean_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    spelled = F.when(F.lower("event_type").isin("t", "yes", "click"), F.lit(" YES ")).otherwise(F.lit("n"))
    return rows.select("event_id", X.yes_or_no(spelled).alias("is_click"), X.yes_or_no((F.col("user_id") % 2).cast("string")).alias("odd"))


@query(phrase_sql() + "SELECT class_id, synonym, doc_id FROM found")
def phrase_match(spark, sf_dir):
    return found_in_documents(spark, sf_dir)[0].select("class_id", "synonym", "doc_id")


@query(phrase_sql("to") + "SELECT class_id, synonym, doc_id FROM found")
def phrase_match_prefix(spark, sf_dir):
    return found_in_documents(spark, sf_dir, "to")[0].select("class_id", "synonym", "doc_id")


@query(
    f"""WITH s(class_id, synonym) AS (VALUES (0, 'the/of'), (0, 'is. in'), (1, 'and (the)'), (1, 'of-the')),
c AS (SELECT *, {CLEAN.format(x="synonym")} AS cleaned FROM s),
h AS (SELECT item_id, ' ' || array_to_string({TOKENS.format(x=CAPTION.format(x="text"))}, ' ') || ' ' AS hay FROM benchmark)
SELECT class_id, synonym, item_id FROM h JOIN c ON contains(hay, ' ' || array_to_string({TOKENS.format(x="cleaned")}, ' ') || ' ')"""
)
def phrase_match_quoted(spark, sf_dir):
    rows = [(0, "the/of", 0, 0), (0, "is. in", 0, 1), (1, "and (the)", 0, 0), (1, "of-the", 0, 1)]
    phrases = M.phrases_of(spark.createDataFrame(rows, "class_id int, synonym string, cnt int, ord int"))
    return M.matches(table(spark, sf_dir, "benchmark"), phrases, ["item_id"]).select("class_id", "synonym", "item_id")


@query(phrase_sql() + "SELECT class_id, synonym, CAST(cnt AS BIGINT) AS cnt, prio, skipped FROM ph")
def synonym_priority(spark, sf_dir):
    return M.phrases_of(synonyms(spark)).select("class_id", "synonym", F.col("cnt").cast("long").alias("cnt"), F.col("prio").cast("long").alias("prio"), "skipped")


@query(phrase_sql() + f", {MINED} SELECT class_id, synonym, CAST(doc_id % 32 AS BIGINT) AS shard, doc_id, md5(text) AS digest FROM mined")
def mined_captions(spark, sf_dir):
    rows = M.attributed(found_in_documents(spark, sf_dir)[0], ["doc_id"])
    return rows.select("class_id", "synonym", (F.col("doc_id") % 32).alias("shard"), "doc_id", F.md5("text").alias("digest"))


@query(phrase_sql() + f", {COUNTS} SELECT class_id, synonym, skipped, cnt FROM counts")
def synonym_counts(spark, sf_dir):
    return M.synonym_counts(*found_in_documents(spark, sf_dir)).select("class_id", "synonym", "skipped", "cnt")


@query(phrase_sql() + f", {MINED}, {NAME_SQL} SELECT class_id, name, count(doc_id) AS actual_freq FROM names LEFT JOIN mined USING (class_id) GROUP BY ALL")
def class_frequency(spark, sf_dir):
    names = spark.createDataFrame([(c, n) for c, n, _ in CLASSES], "class_id int, name string")
    n = M.attributed(found_in_documents(spark, sf_dir)[0], ["doc_id"]).groupBy("class_id").agg(F.count("doc_id").alias("n"))
    return names.join(n, "class_id", "left").select("class_id", "name", F.coalesce("n", F.lit(0)).alias("actual_freq"))


def _name_sql(strict: bool) -> str:
    a, b = (WORDS.format(x=BARE.format(x=CLEAN.format(x=c))) for c in ("top_name", "name"))
    allowed = "true" if strict else f"({a} = {b} OR len(list_filter({a}, lambda w: NOT list_contains({b}, w))) > 0)"
    return (
        phrase_sql()
        + f""", {COUNTS}, {NAME_SQL},
o AS (SELECT class_id, name, coalesce(max(CASE WHEN synonym = name THEN cnt END), max(CASE WHEN synonym = {CLEAN.format(x="name")} THEN cnt END), 0) AS own FROM counts JOIN names USING (class_id) GROUP BY ALL),
t AS (SELECT class_id, synonym AS top_name, cnt AS top_cnt FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY cnt DESC, ord) AS rn FROM counts) WHERE rn = 1)
SELECT class_id, CASE WHEN top_cnt > own AND {allowed} THEN top_name ELSE name END AS most_common_name FROM o JOIN t USING (class_id)"""
    )


def _names(spark, sf_dir, strict):
    names = spark.createDataFrame([(c, n) for c, n, _ in CLASSES], "class_id int, name string")
    return M.most_common_name(names, M.synonym_counts(*found_in_documents(spark, sf_dir)), strict)


@query(_name_sql(False))
def most_common_name_relaxed(spark, sf_dir):
    return _names(spark, sf_dir, False)


@query(_name_sql(True))
def most_common_name_strict(spark, sf_dir):
    return _names(spark, sf_dir, True)


@query("SELECT p_brand AS class_id, p_type AS name FROM (SELECT p_brand, p_type, lower(p_type) AS low FROM part GROUP BY ALL) c WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = c.p_brand AND p.p_size > 45 AND lower(p.p_type) = c.low)")
def name_coverage_lint(spark, sf_dir):
    """Names whose lower-cased form is no key of their class's alternates: types of a brand against those of its large parts."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("class_id"), F.col("p_type").alias("name"), "p_size")
    keys = part.filter("p_size > 45").groupBy("class_id").agg(F.collect_set(F.lower("name")).alias("k"))  # a brand has few types
    alternates = F.map_from_arrays("k", F.array_repeat(F.lit(0), F.size("k")))
    classes = part.select("class_id", "name").distinct().join(keys.select("class_id", alternates.alias("alternates")), "class_id", "left")
    return classes.filter(F.col("alternates").isNull() | ~F.map_contains_key("alternates", F.lower("name"))).select("class_id", "name")


def _download(how: str, k: int, few: int = 5):
    def run(spark, sf_dir):
        mined = M.attributed(found_in_documents(spark, sf_dir)[0], ["doc_id"]).withColumn("score", F.length("text"))
        return M.download_sample(mined, how, ["doc_id"], k, few, score="score").select("class_id", "doc_id")

    return run


for _how, _order in (("all", None), ("random", "md5('0|' || doc_id), doc_id"), ("few", "doc_id"), ("ranked", "length(text) DESC, doc_id")):
    QUERIES[f"download_sample_{_how}"] = _download(_how, 40)
    _limit = "" if _order is None else f" QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY {_order}) <= {5 if _how == 'few' else 40}"
    ORACLES[f"download_sample_{_how}"] = phrase_sql() + f", {MINED} SELECT class_id, doc_id FROM mined{_limit}"


@query(phrase_sql() + f", {MINED} SELECT class_id, m.doc_id, url, coalesce(quality, -1) AS quality, CASE WHEN toxic = 1 THEN 'NSFW' END AS nsfw FROM mined m LEFT JOIN pages ON page_id = m.doc_id LEFT JOIN labels l ON l.doc_id = m.doc_id")
def url_lookup(spark, sf_dir):
    """Mined rows with the url and flags stored under their key."""
    mined = M.attributed(found_in_documents(spark, sf_dir)[0], ["doc_id"]).select("class_id", "doc_id")
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    flags = table(spark, sf_dir, "labels").select("doc_id", "quality", F.when(F.col("toxic") == 1, F.lit("NSFW")).alias("nsfw"))
    return mined.join(urls, "doc_id", "left").join(flags, "doc_id", "left").select("class_id", "doc_id", "url", F.coalesce("quality", F.lit(-1)).alias("quality"), "nsfw")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE (CASE WHEN toxic = 1 THEN 'NSFW' END) IS DISTINCT FROM 'NSFW' AND coalesce(quality, 1) = 1")
def nsfw_gate(spark, sf_dir):
    flags = table(spark, sf_dir, "labels").select("doc_id", "quality", F.when(F.col("toxic") == 1, F.lit("NSFW")).alias("nsfw"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(flags, "doc_id", "left")
    return rows.filter(~F.col("nsfw").eqNullSafe("NSFW") & (F.coalesce("quality", F.lit(1)) == 1)).select("doc_id")


@query(
    """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN p.page_id IS NULL THEN 'no image' WHEN l.doc_id IS NULL THEN 'no caption' ELSE 'valid' END AS kind
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY kind"""
)
def valid_image_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(True).alias("image"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("caption"))
    kind = F.when(F.col("image").isNull(), "no image").when(F.col("caption").isNull(), "no caption").otherwise("valid")
    return docs.join(pages, "doc_id", "left").join(labels, "doc_id", "left").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type, user_id, round(value, 4) AS value FROM events")
def metrics_json_roundtrip(spark, sf_dir):
    """Rows to JSON and back with a stated schema."""
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_type", "user_id", F.round("value", 4).alias("value"))).alias("j"))
    back = F.from_json("j", "event_type string, user_id bigint, value double")
    return rows.select("event_id", back.alias("r")).select("event_id", "r.*")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def keyed_map_counts(spark, sf_dir):
    """Counts by key through maps: entries to a map, looked up again with a default."""
    t = table(spark, sf_dir, "events")
    n = t.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    m = n.agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("n", "users")))).alias("m"))  # a key for each type
    names = t.select("event_type").distinct()
    return names.crossJoin(F.broadcast(m)).select("event_type", F.coalesce(F.element_at("m", F.col("event_type"))["n"], F.lit(0)).alias("n"), F.element_at("m", F.col("event_type"))["users"].alias("users"))


@query("SELECT label, list_sort(list(vec_id)) [1] AS first_id, count(*) AS n, sum(CAST(vec_id AS BIGINT))::BIGINT AS total FROM embeddings GROUP BY label")
def transpose_by_group(spark, sf_dir):
    """One row for each class from parallel columns, without gathering the class."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("total"))


def _indexed(spark, sf_dir):
    """Documents as a stored index: the shards of even numbers first, then those of odd numbers, and one of them again."""
    at = scratch(spark)
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 4).cast("int").alias("shard"), F.col("doc_id").alias("row"), "text")
    I.add_shards(docs.filter("shard % 2 = 0"), at)
    I.add_shards(docs.filter("shard % 2 = 1"), at)
    I.add_shards(docs.filter("shard = 3"), at)
    return at


@query(phrase_sql() + "SELECT class_id, synonym, doc_id FROM found")
def phrase_match_indexed(spark, sf_dir):
    """Names found in a stored index; the texts are read when it is built, not when it is asked."""
    return I.indexed_matches(spark, _indexed(spark, sf_dir), M.phrases_of(synonyms(spark))).select("class_id", "synonym", F.col("row").alias("doc_id"))


#: Names as lists have them, with what a full-text search makes of each: phrases of tokens, "*" after an open one, or none
ODD_NAMES = ["of & the", "the, of", "is (in)", "de/la", "c++", "th* of", "the ^of", "(the", "über", "u. s.", "le les", "and:", "—", "f-16"]
ODD_SQL = """odd(synonym, asks) AS (VALUES ('of & the', NULL), ('the, of', NULL), ('is (in)', ['% to %', '% is in %']), ('de/la', ['% to de la %']), ('c++', NULL), ('th* of', ['% to %', '% th% of %']), ('the ^of', NULL),
  ('(the', NULL), ('über', ['% to %', '% uber %']), ('u. s.', ['% to u s %']), ('le les', ['% to %', '% le les %']), ('and:', NULL), ('—', ['% to %']), ('f-16', ['% to %', '% f 16 %']))"""


@query(phrase_sql() + f", {ODD_SQL} SELECT synonym, asks IS NOT NULL AS readable, count(doc_id) AS n FROM odd LEFT JOIN dh ON asks IS NOT NULL AND len(list_filter(asks, lambda a: NOT regexp_matches(hay, replace(replace(trim(a, '%'), '% ', '[^ ]* '), '%', '.*')))) = 0 GROUP BY ALL")
def phrase_match_expressions(spark, sf_dir):
    """Names with signs in them, sought with a prefix: whether they can be read, and the documents that they match."""
    names = spark.createDataFrame([(k, n, 1, k) for k, n in enumerate(ODD_NAMES)], "class_id int, synonym string, cnt int, ord int")
    phrases = M.phrases_of(names, "to")
    n = M.matches(table(spark, sf_dir, "documents"), phrases, ["doc_id"]).groupBy("synonym").agg(F.count(F.lit(1)).alias("n"))
    return phrases.select("synonym", F.col("error").isNull().alias("readable")).join(n, "synonym", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(
    phrase_sql()
    + """, sized AS (SELECT doc_id, doc_id % 4 AS shard, hay, len(string_split(trim(hay), ' ')) AS n FROM dh),
sh AS (SELECT shard, count(*) AS rows, avg(n) AS mean FROM sized GROUP BY shard),
hit AS (SELECT class_id, synonym, s.doc_id, s.shard, n, CAST((length(h2) - length(replace(h2, p2, ''))) / length(p2) AS DOUBLE) AS tf FROM found f JOIN (SELECT *, replace(hay, ' ', '  ') AS h2 FROM sized) s USING (doc_id) JOIN (SELECT class_id, synonym, ' ' || replace(trim(phrase), ' ', '  ') || ' ' AS p2 FROM ph) USING (class_id, synonym)),
df AS (SELECT class_id, synonym, shard, count(*) AS df FROM hit GROUP BY ALL),
sco AS (SELECT class_id, synonym, doc_id, shard, greatest(CASE WHEN ln((rows - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((rows - df + 0.5) / (df + 0.5)) END, 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) AS score FROM hit JOIN df USING (class_id, synonym, shard) JOIN sh USING (shard))
SELECT class_id, synonym, CAST(shard AS INT) AS shard, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY class_id, synonym, shard ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sco QUALIFY rank <= 5"""
)
def phrase_rank(spark, sf_dir):
    """The five most relevant documents of each shard for each name."""
    rows = I.ranked(spark, _indexed(spark, sf_dir), M.phrases_of(synonyms(spark))).withColumn("score", F.round("score", 6))
    order = W.partitionBy("class_id", "synonym", "shard").orderBy(F.desc("score"), "row")
    return rows.withColumn("rank", F.row_number().over(order)).filter("rank <= 5").select("class_id", "synonym", "shard", F.col("row").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))
