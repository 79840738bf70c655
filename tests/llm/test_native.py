"""Url rules, mixing, sharding and preference formatting on small tables."""

import collections
import math

from graderoom.llm.mixing import mix_sources, poisson_cdf, source_rates
from graderoom.llm.preference import format_preferences, preferences_from_turns
from graderoom.llm.queries import URL_RULES
from graderoom.llm.sharding import interleave
from graderoom.llm.urls import judge_urls
from pyspark.sql import functions as F


def test_url_precedence_and_odd_urls(spark):
    urls = ["http://A.example.NET/en/1", "http://example.net/de/1", "https://x.org/fr/2?q", "https://x.org", None,
            "no scheme", "http://notexample.com/de/1", "http://b.example.com/de/", "http://example.net?x", "://h.net/a#b"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/de/1", "net/", "block")
    assert got[2] == ("x.org", "/fr/2", "org/fr/", "allow")
    assert got[3] == ("x.org", "", None, "allow")
    assert got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6] == ("notexample.com", "/de/1", None, "allow")
    assert got[7][2:] == ("example.com/de/", "block")
    assert got[8] == ("example.net", "", None, "allow")
    assert got[9] == ("h.net", "/a", "net/", "block")
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_poisson_cdf_is_the_distribution(spark):
    rates = [0.05, 1.0, 7.5, 300.0]
    for rate, cdf in spark.createDataFrame([(r,) for r in rates], "r double").select("r", poisson_cdf(F.col("r"))).collect():
        assert abs(cdf[0] - math.exp(-rate)) < 1e-12
        assert abs(cdf[-1] - 1) < 1e-9 and all(a <= b for a, b in zip(cdf, cdf[1:]))


def test_mixing_follows_targets(spark, docs_of):
    docs = docs_of(*[(i, "t", "a" if i % 4 else "b") for i in range(4000)], (None, None, None))
    targets = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    rates = {r["_source"]: r["_rate"] for r in source_rates(docs, targets).collect()}
    assert abs(rates["b"] / rates["a"] - 3) < 1e-9 and rates[""] == 0
    rows = mix_sources(docs, targets).collect()
    share = collections.Counter(r.source for r in rows)
    assert abs(share["a"] - share["b"]) < 300 and None not in share
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    again = mix_sources(docs.repartition(7), targets).collect()
    assert collections.Counter((r.doc_id, r.copy) for r in rows) == collections.Counter((r.doc_id, r.copy) for r in again)
    assert mix_sources(docs.limit(0)).count() == 0


def test_shards_are_even_and_keep_the_mixture(docs_of):
    docs = docs_of(*[(i, "x" * (i % 9), "hot" if i % 3 else f"s{i % 5}") for i in range(1003)], (None, None, None), (5, "", "hot"))
    rows = interleave(docs, 16).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = [len(v) for v in by.values()]
    assert len(rows) == 1005 and len(by) == 16 and max(sizes) - min(sizes) <= 1
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        hot = sum(r.source == "hot" for r in part)
        assert abs(hot - len(part) * 669 / 1005) <= 2
    assert interleave(docs.limit(0)).count() == 0


def test_preferences(spark):
    turn = "array<struct<role:string,text:string>>"
    a, b, c = {"role": "user", "text": "hi"}, {"role": "assistant", "text": "yes"}, {"role": "assistant", "text": None}
    pairs = spark.createDataFrame([(1, [a, b], [a, c]), (2, [a], [a]), (3, [a, b], None)],
                                  f"id int, chosen {turn}, rejected {turn}").withColumn("prompt", F.lit("old"))
    got = {r.id: r for r in format_preferences(pairs).collect()}
    assert got[1].n_common == 1 and got[1].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    (span,) = got[1].chosen_spans
    assert got[1].chosen_text[span.start:span.end] == "yes" and got[1].rejected_spans[0].start == got[1].rejected_spans[0].end
    assert got[2].n_common == 1 and got[2].chosen_text == got[2].rejected_text == ""
    assert got[3].n_common == 0 and got[3].prompt == "" and got[3].rejected_text == ""
    turns = spark.createDataFrame(
        [(i, t, "user" if t == 0 else "assistant", "same" if t == 0 and i < 6 else f"{i} <|im_end|>") for i in range(7) for t in range(2)]
        + [(9, None, None, None)], "conv_id long, turn long, role string, text string")
    rows = preferences_from_turns(turns).collect()
    seen = [x for r in rows for x in (r.chosen_id, r.rejected_id) if x is not None]
    assert sorted(seen) == [0, 1, 2, 3, 4, 5, 6, 9] and sum(r.n_common == 1 for r in rows) >= 2
    assert all(t.count("<|im_end|>") == t.count("<|im_start|>") for r in rows for t in (r.chosen_text, r.rejected_text))
    assert preferences_from_turns(turns.limit(0)).count() == 0


def test_turns_without_a_conversation_are_kept(spark):
    """Every turn is in one output row; a null id is never paired with itself by another's id."""
    def texts(rows):
        return sorted(x for r in rows for side in (r.chosen, r.rejected) for x in ([t.text for t in side] if side else []))

    schema = "conv_id long, turn long, role string, text string"
    pair = spark.createDataFrame([(5, 0, "user", "five"), (None, 0, "user", "none")], schema)
    (row,) = preferences_from_turns(pair).collect()
    assert (row.chosen_id, row.rejected_id) == (5, None) and texts([row]) == ["five", "none"]
    many = spark.createDataFrame(
        [(i, t, "user", f"{i} {t}") for i in range(4) for t in range(2)]
        + [(None, t, None if t % 2 else "user", "same" if t < 4 else f"alone {t}") for t in range(9)], schema)
    rows = preferences_from_turns(many).collect()
    assert texts(rows) == sorted(r.text for r in many.collect()) and len(rows) == 7
    assert sum(r.rejected is None for r in rows) == 1
