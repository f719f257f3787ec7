"""Shards, archives, URL verdicts, mixing, search, rules and language on odd rows."""

import base64
import gzip
import hashlib
import io
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlag.llm import catalog, common, language_id, mixing, quality_rules, sharding, url_filter, vector_search, warc
from airlag.session import ensure_checkpoint_dir
from tests.conftest import SF_SMALL
from tests.llm import data
from tests.oracle import compare


@pytest.fixture(scope="module")
def docs(spark):
    return data.documents(spark).cache()


@pytest.mark.parametrize("key", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck_small, key):
    assert compare(catalog.QUERIES[key](spark, SF_SMALL), duck_small, catalog.ORACLE_SQL[key]) == []


def test_shards_are_contiguous_and_even(spark, docs):
    got = sharding.shard_rows(docs, 5).collect()
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in data.rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    shards = defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        shards[r["shard"]].append(r)
    last = None
    for s in sorted(shards):
        members = sorted(shards[s], key=lambda r: r["slot"])
        assert [r["slot"] for r in members] == list(range(len(members)))
        assert abs(sum(r["size"] for r in members) - total / 5) <= largest
        for r in members:
            key = (r["doc_id"] is not None, r["doc_id"] or 0)
            assert last is None or last <= key
            last = key
    assert sharding.shard_rows(data.empty(spark)).count() == 0


PAGES = "page_id long, url string, html string, digest string, payload string, first long"


def page_rows():
    same = "<p>" + "é" * 500 + "</p>"
    return [*((i, f"http://h{i}.example.com/{i}", f"<p>{i}</p>" * (i + 1)) for i in range(40)), *((100 + i, "http://x/", same) for i in range(9)),
            (200, None, None), (201, "u\r\nv", ""), (202, "w", None), (None, "z", "only"), (None, "z", same), (300, "r", "twice"), (300, "r", "twice"),
            (301, "long", "y" * 3_000_000)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*r, "d", "p", 1) for r in page_rows()], PAGES).repartition(3)
    folder = f"{ensure_checkpoint_dir(spark)}/warc-test"
    files = warc.write_warc(pages, folder, "2026-01-01T00:00:00Z", file_bytes=2000)
    groups = defaultdict(list)
    for p, _, h in page_rows():
        groups[(h or "").encode()].append(p)
    want = Counter()
    for p, _, h in page_rows():
        raw = (h or "").encode()
        first = max((x for x in groups[raw] if x is not None), default=None)
        response = p == first
        want[p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit",
             None if response else first] += 1
    for split in (1500, 1 << 14, 1 << 30):
        rows = warc.read_warc(files, split_bytes=split).collect()
        key = lambda x: None if x is None else int(x)
        assert Counter((key(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], key(r["refers_to"]))
                       for r in rows) == want
    html = {p: h for p, _, h in page_rows()}
    for r in rows:
        if r["record_type"] == "response" and r["record_id"]:
            assert bytes(r["payload"]).decode() == (html[int(r["record_id"])] or "")
    one = files.orderBy(F.desc("bytes")).first()["path"].removeprefix("file:")
    with gzip.open(one) as f:  # any gzip reader reads the archive
        assert f.read(6) == b"WARC/1"
    none = warc.write_warc(pages.limit(0), f"{folder}-none", "2026-01-01T00:00:00Z")
    assert warc.read_warc(none).count() == 0


def test_false_magic_is_not_a_record():
    record = warc.encode_record(1, "u", b"hello", None, False, "d")
    noise = gzip.compress(b"not a record at all") + b"\x1f\x8b\x08junk" + b"\x1f\x8b"
    raw = noise + record + noise + record
    assert [p for p, _ in warc.members(io.BytesIO(raw), 0, len(raw))] == [len(noise), 2 * len(noise) + len(record)]
    assert [p for p, _ in warc.members(io.BytesIO(raw), len(noise) + 1, len(raw))] == [2 * len(noise) + len(record)]
    assert list(warc.members(io.BytesIO(raw), 0, len(noise))) == []


def test_damaged_or_cut_archives_are_errors():
    records = [warc.encode_record(i, "u", b"hello" * 50, None, False, "d") for i in range(4)]
    raw, end = b"".join(records), len(records[0]) + len(records[1])

    def read(raw, split, strict):
        return [p for lo in range(0, len(raw), split) for p, _ in warc.members(io.BytesIO(raw), lo, lo + split, strict)]

    body = end + len(records[2]) // 2  # within the third record
    start = raw[:end] + bytes(4) + raw[end + 4:]
    for split in (100, len(records[0]), 1 << 20):
        assert len(read(raw, split, True)) == len(read(raw, split, False)) == 4
        for bad in (raw[:body] + bytes([raw[body] ^ 255]) + raw[body + 1:], raw[:-5], raw[:-9]):
            for strict in (True, False):
                with pytest.raises(ValueError):
                    read(bad, split, strict)
        for bad in (start, b"?" + raw, raw + b"\x1f", raw[:end + 2]):
            with pytest.raises(ValueError):
                read(bad, split, True)


def test_archive_of_another_size_is_an_error(spark):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>", "d", "p", 1) for i in range(9)], PAGES)
    files = warc.write_warc(pages, f"{ensure_checkpoint_dir(spark)}/warc-size", "2026-01-01T00:00:00Z")
    with pytest.raises(Exception, match="bytes, not"):
        warc.read_warc(files.withColumn("bytes", F.col("bytes") + 1)).count()


def test_url_verdicts(spark):
    urls = ["http://A.Example.NET/en/x", "http://example.net", "http://example.net/", "https://x.org/fr/1?q#f", "https://x.org/de/",
            "http://spam-site.example.com/a/?utm_source=1&b=2", "https://www.spam-site.example.com/a?b=2#z", "nothing", None, "", "://h", "http://",
            "http://notexample.com/de/", "http://m.example.com/de/1", "http://spam.example.org/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, block string")
    for blocks in (1 << 15, 1):  # one block: everything is a possible hit
        rows = url_filter.judge_urls(pages, url_filter.listed_urls(pages), blocks=blocks).collect()
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
        assert len(rows) == len(urls) + 1
        assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
        assert got[1] == ("example.net", "", None, "allow") and got[2][2:] == ("net/", "block")
        assert got[3] == ("x.org", "/fr/1", "org/fr/", "allow") and got[4][2:] == (None, "allow")
        assert got[5][3] == got[6][3] == "block" and got[7] == got[8] == got[9] == ("", "", None, "allow")
        assert got[10] == ("h", "", None, "allow") and got[13][2:] == ("example.com/de/", "block") and got[12][2] is None
        assert got[14][2:] == (None, "block")
    assert url_filter.judge_urls(pages.limit(0), pages.limit(0).select(F.col("url").alias("canonical"))).count() == 0


def brute_rake(cells, targets):
    total = sum(cells.values())
    goal = []
    for d, name in enumerate(mixing.DIMENSIONS):
        mass = Counter()
        for key, n in cells.items():
            mass[key[d]] += n
        z = sum(m ** targets[name] for m in mass.values())
        goal.append({k: m ** targets[name] / z for k, m in mass.items()})
    share = {k: n / total for k, n in cells.items()}
    last = float("inf")
    while True:
        for _ in range(mixing.TURN):
            for d in range(3):
                mass = Counter()
                for key, s in share.items():
                    mass[key[d]] += s
                share = {k: s * goal[d][k[d]] / mass[k[d]] for k, s in share.items()}
        error = max(abs(sum(s for k, s in share.items() if k[d] == c) - t) for d in range(3) for c, t in goal[d].items())
        if error <= mixing.TOLERANCE or error > last * (1 - mixing.LEAST_GAIN):
            return share
        last = error


def test_mixing_matches_brute_force(spark, docs):
    rows = mixing.mix_rows(docs.drop("topic"), keep_tokens=0.7).collect()
    assert len(rows) == len(data.rows())
    cells = Counter()
    for r in rows:
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    share = brute_rake(cells, mixing.TARGETS)
    for r in rows:
        key = (r["source"], r["lang"], r["topic"])
        assert r["share"] == pytest.approx(share[key], rel=1e-9)
    rate = {(r["source"], r["lang"], r["topic"]): r["rate"] for r in rows}
    assert sum(cells[k] * rate[k] for k in cells) == pytest.approx(0.7 * sum(cells.values()), rel=1e-9)
    factors = {round(rate[k] * cells[k] / share[k], 3) for k in cells if rate[k] < 1}
    assert len(factors) <= 1
    kept = mixing.mix(docs, keep_tokens=0.7)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if r["sampled"])
    assert mixing.mix_rows(data.empty(spark)).count() == 0 and mixing.mix(data.empty(spark)).count() == 0


def test_named_targets_are_met(spark):
    docs = spark.createDataFrame([(i, data.prose(i, 60), "en" if i % 10 else "de", f"s{i % 4}", 1) for i in range(400)], data.DOCS)
    rows = mixing.mix_rows(docs, {"lang": {"de": 0.4, "en": 0.6}, "source": 0.0}, keep_tokens=0.2)
    got = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum(F.col("rate") * F.col("n_tokens"))).collect()}
    assert got["de"] / (got["de"] + got["en"]) == pytest.approx(0.4, abs=0.01)


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 16).round(1)]) for i in range(700)]
    rows += [(700 + i, rows[50][1]) for i in range(8)] + [(50, rows[50][1]), (60, rows[60][1])]  # ties and repeated rows
    odd = [(800, None), (850, []), (900, [None] * 16), (950, [float("nan")] * 16), (1000, [float("inf")] * 16), (1050, [1e30] * 16),
           (1100, [0.5, -0.5]), (1101, [1.0, 1.0]), (None, [0.1] * 16)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<float>, query int, dim string").repartition(3)
    got = vector_search.top_k(df, df.where("vec_id % 50 = 0")).collect()
    want = Counter()
    usable = rows + [(1100, [0.5, -0.5]), (1101, [1.0, 1.0])]
    ints = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in usable]
    for q, v in {(i, tuple(x)): (i, x) for i, x in ints if i % 50 == 0}.values():
        best = sorted((-int(v @ x), i) for i, x in ints if i != q and len(x) == len(v))[:5]
        want.update((q, rank + 1, i, -s) for rank, (s, i) in enumerate(best))
    assert Counter(tuple(r) for r in got) == want
    assert vector_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_search_sends_no_blocks_through_the_driver(spark, monkeypatch):
    for name, size in (("CANDIDATE_BLOCK", 16), ("QUERY_BLOCK", 4), ("GROUP_BLOCKS", 2)):
        monkeypatch.setattr(vector_search, name, size)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 4 + i % 2).round(1)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    found = vector_search.top_k(df, df.where("vec_id % 10 = 0"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    ints = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows]
    want = set()
    for q, v in ints[::10]:
        best = sorted((-int(v @ x), i) for i, x in ints if i != q and len(x) == len(v))[:5]
        want |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("scale", [50, 1e7, 1e8])  # beyond 2**53 no sum of floats is exact
def test_whole_blocks_score_as_pairs_do(monkeypatch, scale):
    rng = np.random.default_rng(9)
    q, c = (rng.normal(0, scale, (n, 24)).round().astype(np.int64) for n in (30, 200))
    c[100:] = c[:100]  # ties
    levels = [vector_search.segment_statistics(c.astype(float), s) for s in vector_search.RESOLUTIONS]
    want = [sorted((-int(a @ b), j) for j, b in enumerate(c) if i != j)[:5] for i, a in enumerate(q)]
    for dense in (0, 1 << 40):  # never and always
        monkeypatch.setattr(vector_search, "DENSE", dense)
        best = vector_search.Best(np.arange(30), q, 5)
        best.meet(np.arange(200), c, levels)
        assert best.found == want


def test_segment_bounds_hold():
    rng = np.random.default_rng(5)
    q, c = rng.normal(0, 50, (20, 30)).round(), rng.normal(3, 70, (50, 30)).round()
    for segments in (1, 4, 16, 64):
        assert (vector_search.segment_statistics(q, segments) @ vector_search.segment_statistics(c, segments).T >= q @ c.T - 1e-6).all()


def brute_counts(text):
    text = text or ""
    w = data.words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    inside = {j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def test_quality_counts_and_rules(spark, docs):
    junk = [(1000 + i, " ".join(f"{w}###" for w in data.prose(i, 80).split()), "en", "s", 1) for i in range(60)]
    more = docs.drop(*data.CLASHES).unionByName(spark.createDataFrame(junk, data.DOCS))
    labels = spark.createDataFrame([(i, 1, 0, "a") for i in range(1, 40)] + [(1000 + i, 0, 0, "a") for i in range(60)]
                                   + [(1, 1, 0, "a"), (None, 0, 0, "b"), (500, None, None, "c")], "doc_id long, quality int, toxic int, n_words string")
    rules = quality_rules.fit(more, labels)
    assert rules and all(1 <= len(r) <= quality_rules.MAX_CONDITIONS for r in rules)
    got = quality_rules.judge(more, rules).select("row.doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept", "rule").collect()
    want = Counter()
    for d, t, *_ in [*data.rows(), *junk]:
        c = brute_counts(t)
        want[(d, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(kept[1000 + i] for i in range(60)) and all(kept[i] for i in range(1, 40) if 40 + 13 * i % 260 >= 50)
    good = quality_rules.keep_good(docs, labels)
    assert good.columns == docs.columns and good.count() > 30
    assert quality_rules.fit(data.empty(spark), labels.limit(0)) == []
    assert quality_rules.judge(data.empty(spark), []).count() == 0


def test_column_rules_equal_numpy_rules(spark, docs):
    rule = [quality_rules.Condition("symbol_share", True, 1), quality_rules.Condition("distinct_share", False, 990)]
    rows = quality_rules.judge(docs, [rule]).select(*quality_rules.COUNTS, F.col("rule").isNotNull().alias("hit")).collect()
    counts = np.array([[r[c] for c in quality_rules.COUNTS] for r in rows], np.int64)
    assert quality_rules._covers(rule, quality_rules.statistics(counts)).tolist() == [r["hit"] for r in rows]


def test_language(spark, docs):
    real = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    network = language_id.fit(real)
    got = language_id.predict(docs, network).collect()
    assert len(got) == len(data.rows()) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by_id[500] == by_id[501] == by_id[502] == by_id[506] == "und" and by_id[600] in network.languages
    held = (catalog.QUERIES["op8_language_id"](spark, SF_SMALL).where("held_out").join(real.select("doc_id", "lang", "n_chars"), "doc_id")
            .where("n_chars > 200").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0])
    assert held >= 0.9
    nothing = language_id.predict(docs, language_id.fit(docs.limit(0)))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert language_id.predict(data.empty(spark), network).count() == 0


def test_salted_join_spreads_a_hot_key(spark, monkeypatch):
    monkeypatch.setitem(common.__dict__, "HOT_PARTS", 500)
    left = spark.range(20_000).select(F.col("id").alias("row"), F.when(F.col("id") < 18_000, 0).otherwise(F.col("id")).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k % 2 = 0").withColumn("found", F.lit(True))
    kept = {x: spark.conf.get(x) for x in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for how in ("left", "inner"):
            out = common.salted_join(left, right.select("k", "found"), ["k"], right.select("k", "n"), 20_000, how)
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert max(sizes) <= 3 * np.median(sizes)
            got, want = out.orderBy("row").collect(), left.join(right.select("k", "found"), "k", how).orderBy("row").collect()
            assert got == want
        empty = common.salted_join(left.limit(0), right.select("k", "found"), ["k"], right.select("k", "n").limit(0), 0, "left")
        assert empty.count() == 0
    finally:
        for x, v in kept.items():
            spark.conf.set(x, v)


def test_copies_of_one_payload_have_one_response(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"),
                                     F.when(F.col("id") % 10 > 0, "error page").otherwise(F.concat(F.lit("p"), "id")).alias("html"))
    pages = pages.unionByName(pages.where("page_id = 2999"))
    files = warc.write_warc(pages, f"{ensure_checkpoint_dir(spark)}/warc-hot", "2026-01-01T00:00:00Z")
    got = warc.read_warc(files).groupBy("record_type", F.coalesce("refers_to", F.lit("-")).alias("to")).count().collect()
    assert {(r["record_type"], r["to"]): r["count"] for r in got} == {("response", "-"): 302, ("revisit", "2999"): 2699}
