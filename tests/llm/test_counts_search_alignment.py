"""Token counts, ranked search and tokenizer alignment against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from airlag.llm import language_id, perfect_hash, ranked_search, token_counts, tokenizer_alignment, tokens, vector_search
from tests.conftest import SF_SMALL
from tests.llm import data
from tests.oracle import compare, duck

ODD = ["'s's ''s don't I'LL we've're 'x 'tis '", "!'s a's1's", "x" * 30_000, "'" * 500, "<|endoftext|> a", "İ ſs K", " " * 100_000,
       "é" * 200, "12345 ½²", "é", "1,2.3", "▁ a", "a\x85b\xa0c", "<s> </s> <0x41>", "😀 🤦🏽", "\x00\x01", "日本語 テキスト"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    noise = ["".join(rng.choice("aàb's 'trevld1²!,\n \x85ﬁ—") for _ in range(300)) for _ in range(60)]
    return [r[:2] for r in data.rows()] + [(10_000 + i, t) for i, t in enumerate(ODD + noise)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit("other").alias(c) for c in (*data.CLASHES, "token", "h", "pair", "terms", "rank", "score", "a", "b")]).cache()


@pytest.mark.parametrize("table", [0, 40, token_counts.TABLE])
def test_token_counts(docs, rows, table, monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(token_counts, "CHUNK", 4000)
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    got = Counter(tuple(r) for r in token_counts.count_tokens(docs, 2048, table=table).collect())
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == Counter((d, len((t or "").encode()), n(t), n(t) > 2048) for d, t in rows)


def test_token_counts_of_every_plain_character(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    texts = [f"a{chr(c)}b 1{chr(c)}{chr(c)}'{chr(c)}s" for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_length_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 2 ** 63, 5000).astype(np.uint64) << np.uint64(8))  # all meet on few slots
    table = token_counts.Lengths(keys, (np.arange(len(keys)) % 60 + 1).astype(np.uint16))
    assert np.array_equal(table.get(keys), np.arange(len(keys)) % 60 + 1)
    assert not table.get(keys + np.uint64(1)).any()


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_search(rows, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", _lower(t))
    held = [(d, Counter(terms(t))) for d, t in rows]
    n_all, l_all = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n_all // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                    for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out.update((item, r, d, -s) for r, (s, _, d) in enumerate(scored[:top], 1))
    return out


@pytest.mark.parametrize("at_once", [1024, 3])
def test_search_against_brute_force(spark, docs, rows, monkeypatch, at_once):
    monkeypatch.setattr(ranked_search, "QUERIES_AT_ONCE", at_once)
    monkeypatch.setattr(ranked_search, "DOCUMENTS", 8)
    rng = random.Random(2)
    words = [f"{rng.choice(data.WORDS)}{rng.randrange(400)}" for _ in range(60)] + ["x", "s", "é" * 200, "One", "日本語"]
    items = [(i, " ".join(rng.sample(words, 12)) + ", X") for i in range(8)] + [(8, None), (9, " ,. "), (9, "alpha1 alpha2 alpha1"), (None, "Two one")]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in ranked_search.search(docs, df, top=7).collect())
    assert got == brute_search(rows, items, 7)
    assert ranked_search.search(docs.limit(0), df).count() == ranked_search.search(docs, df.limit(0)).count() == 0


def test_search_twin(spark):
    con = duck(SF_SMALL)
    assert not compare(ranked_search.op12_ranked_search(spark, SF_SMALL), con, ranked_search.OP12_SQL)


def test_plan_shares_sums():
    rng = np.random.default_rng(3)
    common = [rng.choice(40, 6, replace=False) for _ in range(5)]
    queries = [np.unique(np.concatenate([common[i % 5], common[(i + 1) % 5], rng.choice(np.arange(40, 200), 5)])) for i in range(60)]
    plan = ranked_search.Plan(queries, 200)
    asked = np.isin(np.arange(200), np.concatenate(queries))  # postings hold asked terms only
    doc, term = np.nonzero((rng.random((30, 200)) < 0.3) & asked)
    value = rng.integers(1, 1000, len(doc))
    dense = np.zeros((30, 200), np.int64)
    dense[doc, term] = value
    want = np.stack([dense[:, q].sum(1) for q in queries])
    assert np.array_equal(plan.scores(len(queries), doc, term, value, 30), want)
    additions = len(plan.sums) + sum(map(len, plan.rest))
    assert plan.sums and additions < sum(map(len, queries)) / 2


def brute_alignment(rows):
    """Rows of the digest, by looking at every pair of ranges of a document."""
    import sentencepiece
    from tokenizers import Tokenizer
    a_path, b_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    ta, tb = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    ta.encode_special_tokens = True
    a_bytes, b_bytes = tokenizer_alignment.byte_entries(a_path), tokenizer_alignment.piece_entries(b_path)
    held, count = [], Counter()

    def ranges(ids, names):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(names[i])))
            at += len(names[i])
        return out
    for d, text in rows:
        a = ranges(ta.encode(" " + (text or ""), add_special_tokens=False).ids, a_bytes)
        b = ranges(tb.encode(text or ""), b_bytes)
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(n[i] for i, _, _ in x) != whole for x, n in ((a, a_bytes), (b, b_bytes))):
            a = b = []
        links, j = [], 0
        for i, lo, hi in a:
            while b[j][2] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][1] < hi:
                links.append((i, b[k][0]))
                k += 1
        count.update(links)
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = list(zip([0, *ends], ends, strict=False))
        held.append((d, a, b, links, groups))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = Counter()
    for d, a, b, links, groups in held:
        by = [{}, {}]
        for side, x in enumerate((a, b)):
            g = 0
            for i, _, hi in x:
                while hi > groups[g][1]:
                    g += 1
                by[side].setdefault(g, []).append(str(i))
        text = ";".join(f"{','.join(by[0][g])}|{','.join(by[1][g])}" for g in range(len(groups)))
        out[(d, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(text.encode()).hexdigest() if text else "")] += 1
    return out, len(count)


def test_alignment_against_brute_force(docs, rows, monkeypatch):
    monkeypatch.setattr(tokenizer_alignment, "CHUNK", 3000)
    monkeypatch.setattr(tokenizer_alignment, "BUCKET", 512)
    monkeypatch.setattr(tokenizer_alignment, "FAN_IN", 2)
    want, n_pairs = brute_alignment(rows)
    for most in (tokenizer_alignment.MAX_PAIRS, n_pairs // 10):
        got = Counter(tuple(r) for r in tokenizer_alignment.align_tokenizers(docs, max_pairs=most).collect())
        assert got == want
    assert tokenizer_alignment.align_tokenizers(docs.limit(0)).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(rng.integers(0, 2 ** 62, n).astype(np.uint64))
        levels, numbers = perfect_hash.build(keys)
        assert sorted(numbers) == list(range(len(keys)))
        table = perfect_hash.PerfectHash(levels)
        assert table.size == len(keys) and np.array_equal(table.numbers(keys), numbers)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "\t" * 2_000_000, " \n\t\r" * 500_000, "x" * 2_000_000, "!" * 2_000_000, "😀" * 300_000])
def test_ids_of_long_runs(text):
    exact = tokens._exact(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens.token_ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_every_finite_vector_is_scored(spark):
    rows = [(50, [600000.0, 1.0]), (1, [2.0, 3.0]), (2, [-700000.0, 5.0]), (3, [1e7, 0.0]), (4, [float("inf"), 0.0]), (100, [1e7, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in vector_search.top_k(df, df.where("vec_id % 50 = 0")).collect()}
    ints = {i: [math.floor(256 * x) for x in v] for i, v in rows if i != 4}
    assert got == {(q, c): sum(a * b for a, b in zip(ints[q], ints[c], strict=True)) for q in (50, 100) for c in ints if c != q}
    huge = spark.createDataFrame([(50, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="int|64"):
        vector_search.top_k(huge, huge.where("vec_id = 50")).collect()


def test_language_rules(spark):
    real = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rare = spark.createDataFrame([(900_000 + i, f"zq{'qxz' * 5} xqz zzq {i}", "xx", "s", 1) for i in range(4)], real.schema)
    network = language_id.fit(real.unionByName(rare))
    assert "xx" in network.languages
    again = language_id.fit(rare.unionByName(real).repartition(7))
    assert all(np.array_equal(getattr(network, f), getattr(again, f)) for f in ("embedding", "filters", "dense"))
    texts = ["½ 12", "² ① Ⅷ", "́ 1", "a", "ª", "été où la nuit", "abc " * 3000]
    got = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), network).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] == "und" for i in range(5)] == [True, True, True, False, False]
    for i in (3, 5):  # one number at a time: every filter at every place
        window = texts[i].encode().ljust(language_id.WINDOW, b"\0")
        wide = max(language_id.WIDTHS)
        padded, best = list(window) + [0] * (wide - 1), []
        for f in range(network.filters.shape[1]):
            at = [sum(float(network.embedding[padded[p + k], e]) * float(network.filters[k * language_id.EMBEDDING + e, f])
                      for k in range(wide) for e in range(language_id.EMBEDDING)) for p in range(language_id.WINDOW)]
            best.append(max(0.0, max(at) + float(network.bias[f])))
        logits = [sum(b * float(network.dense[f, g]) for f, b in enumerate(best)) + float(network.offset[g]) for g in range(len(network.languages))]
        p = [math.exp(x - max(logits)) for x in logits]
        assert by_id[i]["lang_pred"] == network.languages[p.index(max(p))] and abs(by_id[i]["score"] - max(p) / sum(p)) < 1e-4
