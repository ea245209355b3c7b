"""Archives, URL rules, neighbours and languages against plain versions."""

import base64
import hashlib

import numpy as np
import pytest
from plain import clashing, ordered
from pyspark.sql import functions as F

from fleetplan.llm import language, neighbours, url_filter, warc
from fleetplan.llm.queries import URL_RULES


def archived(rows, min_bytes=0):
    firsts = {}
    for page, html in rows:
        if page is not None:
            firsts[html or ""] = min(page, firsts.get(html or "", page))
    out = []
    for page, html in rows:
        data = (html or "").encode()
        first = firsts.get(html or "")
        again = len(data) >= min_bytes and page != first
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return out


@pytest.mark.parametrize("min_bytes", [0, 3])
def test_archives(spark, min_bytes):
    rows = [
        (1, "a"), (2, "a"), (3, None), (4, ""), (5, "x" * 200_000), (6, "x" * 200_000), (6, "x" * 200_000), (7, "é\r\n0\r\n\r\n"), (None, "a"),
        (8, "y" * 100_000), (8, "y" * 100_000), (9, "é\r\n0\r\n\r\n"), (10, "WARC/1.1\r\n\r\n"), (11, "z" * 49_000),
    ]
    pages = clashing(spark.createDataFrame([(i, None if i == 1 else f"http://a/\n{i}", h) for i, h in rows], "page_id long, url string, html string"))
    found = warc.read_archives(warc.write_archives(pages, min_bytes=min_bytes))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert ordered(found.select(columns).collect()) == ordered(archived(rows, min_bytes))
    payloads = {(r.page_id, bytes(r.payload)) for r in found.collect() if r.record_type == "response"}
    assert payloads == {(p, (h or "").encode()) for (p, h), a in zip(rows, archived(rows, min_bytes)) if a[3] == "response"}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_reading_takes_time_with_the_bytes(spark):
    """32 MB of payload, the size at which files end, in records of 2,500 bytes."""
    import time

    rng = np.random.default_rng(0)
    pages = [rng.integers(0, 256, 2500, np.uint8).tobytes() for _ in range(13_000)]
    data = b"".join(x for i, p in enumerate(pages) for x in warc.page_records(i, None, p, warc.digest_of(p), None, False))
    began = time.process_time()
    blocks = [warc.message_payload(block) for _, block in warc.records(data)]
    assert time.process_time() - began < 4
    assert blocks == pages
    with pytest.raises(ValueError):
        list(warc.records(data[:-5]))


def test_payloads_can_be_left_out(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b" * 300_000), (3, "u", "a")], "page_id long, url string, html string")
    archives = warc.write_archives(pages)
    assert sorted(r.segmented for r in archives.select("segmented").distinct().collect()) == [False, True]
    whole, less = warc.read_archives(archives), warc.read_archives(archives, payloads=False)
    assert "payload" not in less.columns and ordered(less.collect()) == ordered(whole.drop("payload").collect())


def test_chunks():
    for payload in (b"", b"a", b"\r\n0\r\n\r\n" * 50):
        assert warc.unchunked(warc.chunked(payload, 7)) == payload
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab")


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_url_rules(spark, broadcast, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_ROWS", broadcast)
    urls = [
        None, "", "x", "http://", "http:///a", "http://org/", "http://ORG", "https://a.example.org/es/1?x#y", "http://example.org/en/1", "http://example.org/en/12",
        "http://example.org/en/2", "http://xexample.org/es/", "http://a.com/fr/", "http://com/de/x", "http://É.com/de/", "http://a.com?/de/", "a://b://c.com/de/",
        "http://a.com#/fr/", "http://a.com//de/", "http://.com/de/", "http://x.net/", "http://a.org/\n/es/", "http://example.org/es/", "http://example.org/es/",
    ]
    rules = [*URL_RULES, ("net", "", "block"), (None, "/", "block"), ("", "/", "block")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    pages = clashing(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).withColumn("host", F.lit(1))
    expected = [(i, *judged(u, rules[:-2])) for i, u in enumerate(urls)]
    assert ordered(url_filter.judge_urls(pages, table).collect()) == ordered(expected)
    assert {r.verdict for r in url_filter.judge_urls(pages, table.limit(0)).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0


def test_bloom_filter_passes_all_listed_keys(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    bloom = url_filter.blocked_bloom(keys, 200)
    assert url_filter.possible_hits(keys, bloom, 200).count() == 3000
    others = spark.range(10_000, 30_000).select(F.col("id").cast("string").alias("key"))
    assert url_filter.possible_hits(others, bloom, 200).count() < 1000


def brute_nearest(rows, queries, k):
    out = []
    for q, v in queries:
        scored = [(-neighbours.cosines(np.array(v, float), np.array([w], float))[0], i) for i, w in rows if i != q and len(w) == len(v)]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_nearest_on_odd_rows(spark):
    good = [(i, [float(i % 7 - 3), 1.0, float(i % 5)]) for i in range(60)] + [(100 + i, [2.0, 2.0, 2.0]) for i in range(30)] + [(200, [1.0, 2.0])]
    bad = [(300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0, None, 2.0]), (303, [float("nan"), 1.0, 1.0]), (304, [float("inf"), 1.0, 1.0]), (305, []), (None, [1.0, 1.0, 1.0])]
    vectors = clashing(spark.createDataFrame(good + bad, "vec_id long, embedding array<float>"))
    for rows in (20_000, 10):
        found = neighbours.nearest(vectors, vectors.where("vec_id % 5 = 0"), shard_rows=rows)
        assert ordered(found.collect()) == ordered(brute_nearest(good, [g for g in good if g[0] % 5 == 0], 5))
    assert neighbours.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_nearest_of_repeated_rows(spark):
    rows = [(50, [1.0, 2.0])] * 7 + [(51, [1.0, 2.0]), (52, [2.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = neighbours.nearest(vectors, vectors.where("vec_id <= 51"))
    assert ordered((r.query_id, r["rank"], r.vec_id) for r in found.collect()) == [(50, 1, 51), (50, 2, 52), (51, 1, 50), (51, 2, 52)]


def test_recall_of_the_forest():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((50, 64))
    vectors = centres[rng.integers(0, 50, 20_000)] + rng.standard_normal((20_000, 64))
    forest, hits = neighbours.Forest(vectors), 0
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for i, found in zip(range(100), forest.candidates(vectors[:100])):
        score = unit @ unit[i]
        score[i] = -2
        hits += np.isin(np.argsort(-score)[:5], found).sum()
    assert hits >= 0.9 * 500


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, None, "en"), (-2, "", "de"), (-3, "12 ?! ", None), (-4, "日本語", None), (-5, "a", None), (None, "the and of", "en"), (-6, "“…”", "en"), (-7, "x" * 300_000, None)]
    rows = clashing(docs.union(spark.createDataFrame(odd, docs.schema)))
    found = {r.doc_id: r for r in language.identify_documents(rows).collect()}
    for i in (-1, -2, -3, -6):
        assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
    for i in (-4, -5, None, -7):
        assert found[i].lang_pred in ("en", "de", "fr", "es") and 0 <= found[i].score <= 1
    held = [r for r in docs.where(language.held_out(F.col("doc_id"))).collect()]
    right = sum(found[r.doc_id].lang_pred == r.lang for r in held)
    assert right >= 0.97 * len(held)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify_documents(unlabelled).collect()} == {"und"}
    assert language.identify_documents(docs.limit(0)).count() == 0
    kept = {r.doc_id for r in language.known_language(rows).collect()}
    assert {r.doc_id for r in docs.collect()} <= kept and not kept & {-1, -2, -3, -6}


def test_more_languages_than_bits_of_a_word(spark):
    """130 languages of invented words; every row is of the language it is labelled with."""
    word = lambda lang, i: "".join(chr(97 + int(d, 16)) for d in hashlib.sha1(f"{lang} {i % 40}".encode()).hexdigest()[:8])
    rows = [(i, " ".join(word(i % 130, i // 130 * 7 + j) for j in range(30)), f"l{i % 130:03d}") for i in range(1300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language.identify_documents(docs).select("lang", "lang_pred", "score").collect()
    assert len(found) == 1300 and len({r.lang_pred for r in found}) == 130
    assert all(r.lang_pred == r.lang and r.score > 0.5 for r in found)
    assert language.known_language(docs).count() == 1300
