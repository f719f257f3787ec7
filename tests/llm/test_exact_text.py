"""Substring dedup, n-gram join and packing against brute force on odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from airlag.llm import ngram_join, packing, substring_dedup, tokens, words
from airlag.llm.common import release
from tests.llm import data


@pytest.fixture(scope="module")
def docs(spark):
    return data.documents(spark).cache()


def brute_windows(rows, window):
    texts = [data.words(t) for _, t in rows]
    found = Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if found[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window,seed,crowded", [(35, 10, 1000), (35, 10, 1), (8, 3, 4)])
def test_windows_match_brute_force(docs, monkeypatch, window, seed, crowded):
    monkeypatch.setattr(substring_dedup, "CROWDED", crowded)
    got = Counter(tuple(r) for r in substring_dedup.window_digests(docs, window, seed).collect())
    assert got == brute_windows([(r[0], r[1]) for r in data.rows()], window)


def test_kept_text(spark, docs):
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == data.prose(1, 53) and got[1]["n_chars"] is None and got[500]["text"] is None
    assert got[100]["text"] == f"{data.prose(200, 20)}\n{data.prose(300, 90)}"
    assert got[100]["n_chars"] == len(got[100]["text"]) and got[300]["text"] == ""
    assert substring_dedup.window_digests(data.empty(spark)).count() == 0


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                label[top(i)] = top(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[top(i)].append(i)
    out = []
    for group in members.values():
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids, default=None)) for i in group]
    return Counter(out)


@pytest.mark.parametrize("k,percent,tile,often", [(3, 90, 512, 24), (5, 80, 3, 2), (2, 30, 2, 10**9)])
def test_components_match_brute_force(docs, monkeypatch, k, percent, tile, often):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "FREQUENT", often)
    got = Counter(tuple(r) for r in ngram_join.jaccard_components(docs, k, percent).collect())
    assert got == brute_components([(r[0], r[1]) for r in data.rows()], k, percent)


def test_one_of_each(spark, docs):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert all(ids[i] == 1 for i in range(1, 40)) and ids[200] == 1 and not any(ids[200 + i] for i in range(1, 12))
    assert ids[300] == 1 and ids[301] == 0 and ids[400] == 1
    assert ids[500] == ids[501] == ids[502] == 1 and ids[None] == 1
    assert ngram_join.one_of_each(data.empty(spark)).count() == 0
    assert ngram_join.jaccard_components(data.empty(spark)).count() == 0


def exact_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_token_ids_are_those_of_tokenizers():
    texts = [r[1] or "" for r in data.rows() if len(r[1] or "") < 5000]
    texts += [chr(c) + "a " + chr(c) + chr(c) + "1" for c in range(1, 0x300)] + ["a  b\n\n c\t\td  ", "'s 'll don't 12three"]
    for text in texts:
        assert tokens.token_ids(text).tolist() == exact_ids(text), repr(text)


def test_packing_round_trip(spark, docs):
    got = packing.pack_documents(docs, capacity=256).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    want = defaultdict(list)
    for d, t, *_ in data.rows():
        want[d].append(np.array([*exact_ids(t), 2], "<u4"))
    assert by_doc.keys() == want.keys()
    for d, copies in want.items():
        ids, pieces = copies[0], Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[d])
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)]
        assert pieces == Counter({(i, s, e - s, zlib.crc32(ids[s:e].tobytes())): len(copies)
                                  for i, (s, e) in enumerate(zip(cuts, cuts[1:]))})
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    assert len(sequences) <= 1.02 * sum(r["length"] for r in got) / 256 + 2
    assert packing.pack_documents(data.empty(spark)).count() == 0


def test_evolution_never_loses_pieces_and_beats_nothing_less_than_best_fit():
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 1024, 600).tolist(), reverse=True)
    bins, fills = [], []
    packing.best_fit(range(len(lengths)), lengths, bins, fills, 1024)
    population = packing.evolve(lengths, [], "a", offspring=30)
    best = packing.to_packing(population[0], lengths)
    assert sorted(i for b in best[0] for i in b) == list(range(len(lengths)))
    assert max(best[1]) <= 1024 and len(best[0]) <= len(bins)


def test_word_hashes_depend_on_the_word_alone(monkeypatch):
    texts = [(r[1] or "").encode() for r in data.rows()]
    whole = words.Words(texts)
    assert [whole.buf[s:e].tobytes() for s, e in zip(whole.starts, whole.ends)] == [w for t in texts for w in t.split()]
    seen = {}
    for s, e, h in zip(whole.starts, whole.ends, whole.hashes):
        assert seen.setdefault(whole.buf[s:e].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_release_deletes_scratch(spark):
    release(spark)
    assert release(spark) == 0


def test_a_passage_in_most_texts(spark, monkeypatch):
    monkeypatch.setitem(substring_dedup.salted_join.__globals__, "HOT_PARTS", 20)
    passage = data.prose(4321, 40)
    rows = [(i, f"{data.prose(i, 30)} {passage}\n{data.prose(7000 + i, 12)}" if i % 10 else data.prose(i, 80)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter(tuple(r) for r in substring_dedup.window_digests(docs).collect())
    assert got == brute_windows(rows, 35) and sum(n for (_, _, n, _) in got) >= 360 * 40
