"""Very long texts and urls: whole results, in time that grows with them and no faster."""

import random
import re
import time

from pyspark.sql import functions as F

from seamline.llm import secrets
from seamline.llm.url_filter import UrlTrie, _by_join, judge_urls

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "example.org", "/en/1"), ("block", "com", "/a/b/c"), ("block", "x.com", "")]


def test_long_urls(spark):
    trie = UrlTrie(RULES)
    long = "x" * 1_000_000
    began = time.process_time()
    assert trie.find("www.example.org", "/es/" + long) == ("example.org/es/", "block")
    assert trie.find("example.org", "/" + long) == ("org/", "allow")
    assert trie.find(".".join(["a"] * 200_000) + ".org", "/" + "/".join(["s"] * 300_000)) == ("org/", "allow")
    assert time.process_time() - began < 2
    urls = ["http://example.org/es/" + long, "http://" + "a." * 50_000 + "com/a/b/c" + "/d" * 100_000, "http://x.com", "http://x.com/" + "a/" * 10, None, "", "no url"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    by_trie = {r.page_id: (r.rule, r.verdict) for r in judge_urls(df, RULES).collect()}
    by_join = {r.page_id: (r.rule, r.verdict) for r in judge_urls(df, [*RULES, ("allow", None, "/"), ("allow", "com", None)], max_trie_bytes=0).collect()}
    assert by_trie == by_join == {0: ("example.org/es/", "block"), 1: ("com/a/b/c", "block"), 2: ("x.com", "block"), 3: ("x.com", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow")}


def plain_spans(text):
    out = []
    for place, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), place, m.end(), rule.kind))
    return sorted(out)


def plain_masked(text, mask="<secret>"):
    out, at = [], 0
    for s, _, e, _ in plain_spans(text):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def test_many_secrets_in_long_texts(spark):
    rng = random.Random(7)
    bits = ["token=abcdef12 ", "AKIA" + "Q" * 20 + " ", "0123456789abcdef" * 2 + " ", "é plain words 𝄞 ", "password: 'AKIA" + "Z" * 18 + "' ", "secret=ab ", "\n"]
    texts = ["token=abcdef " * 80_000, "".join(rng.choices(bits, k=3000)), "x" * 5000 + "token=abcdefg" + "é" * 3000 + "AKIA" + "A" * 16, "token=abcdef", "plain", "", None, "".join(rng.choices(bits, k=255)), "token=abcdef" + "0" * 2_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    got = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    for k, t in enumerate(texts):
        assert [(x.s, x.place, x.e, x.kind) for x in got[k].found] == plain_spans(t or ""), k
    hidden = {r.doc_id: r.text for r in secrets.masked(df).collect()}
    for k, t in enumerate(texts):
        assert hidden[k] == (t if t is None else plain_masked(t)), k


def test_times_grow_with_the_text(spark):
    def took(n):
        df = spark.createDataFrame([(1, "token=abcdef " * n)], "doc_id long, text string")
        began = time.time()
        secrets.masked(df).select(F.length("text")).collect()
        return time.time() - began

    took(100)
    assert took(80_000) < 20  # a megabyte; some 2 s on an ordinary machine


def test_running_values(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        xs = [(k * 7919) % 101 for k in range(n)]
        r = spark.createDataFrame([(xs,)], "x array<long>").select(secrets.running(F.col("x"), lambda a, b: a + b).alias("s"), secrets.running(F.col("x"), F.greatest).alias("m")).first()
        assert r.s == [sum(xs[:k]) for k in range(n)] and r.m == [max(xs[:k], default=0) for k in range(n)]
