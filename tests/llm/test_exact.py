"""Operators against brute force, libraries, SQL and held-out labels on the smallest tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from public_tokenizers import path

import corpus_pipeline
from affinity.llm import queries as q
from affinity.llm.licenses import base_sql
from affinity.llm.minhash import Circulant, near_duplicates, shared_counts
from affinity.llm.monotone import EliasFano
from affinity.llm.passages import chains, Fenwick, repeated_passages, seed_places, sketch
from affinity.llm.pieces import PieceEncoder, read_model
from affinity.llm.text import WordHashes, hashes_of, read_table, words_of
from tests.llm import cases

MODEL = path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def least_reachable(nodes, edges):
    above = {n: n for n in nodes}

    def top(n):
        while above[n] != n:
            n = above[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = collections.defaultdict(list)
    for i, s in sorted(sets.items()):
        for g in s:
            holders[g].append(i)
    common = collections.Counter((a, b) for h in holders.values() for n, b in enumerate(h) for a in h[:n])
    edges = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    return sets, least_reachable(sets, edges)


def test_near_duplicates_of_the_table(spark, sf, docs):
    sets, wanted = brute_components(docs)
    rows = q.op2_minhash(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {
        i: (len(sets[i]), wanted[i], wanted[i] == i) for i in docs}


def test_near_duplicates_of_a_family(spark):
    """Copies with more and more changed words: links between strays, not only to the smallest."""
    rng, base = random.Random(4), cases.prose(150, 70)
    texts = {}
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(30)}"
        texts[i] = " ".join(w)
    texts |= {200 + i: texts[i] for i in range(30)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    _, wanted = brute_components(texts)
    assert {r.doc_id: r.component_id for r in near_duplicates(frame).collect()} == wanted


def test_circulant_estimates_similarity():
    rng, circulant = np.random.default_rng(0), Circulant()
    both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (600, 100, 100))
    left, right = circulant.signature(np.concatenate([both, a])), circulant.signature(np.concatenate([both, b]))
    assert abs((left == right).mean() - 0.75) < 0.15
    assert (circulant.signature(both) == circulant.signature(both[::-1])).all()


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n)) for n in (40, 1, 120, 60)]
    wanted = [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:2]]
    assert shared_counts(sets[:2], sets).tolist() == wanted


def test_nearest_recall(spark, sf):
    rows = q.op1_prefix_forest(spark, sf).collect()
    vectors = {r.vec_id: np.array(r.embedding, float) for r in read_table(spark, sf, "embeddings").collect()}
    ids = np.array(sorted(vectors))
    units = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    found = 0
    asked = [i for i in ids if i % 50 == 0]
    for i in asked:
        scores = units @ units[ids == i][0]
        best = [int(j) for j in ids[np.lexsort((ids, -scores))] if j != i][:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == i)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s - scores[ids == j][0]) < 1e-12 for _, j, s in mine)
        found += len({m[1] for m in mine} & set(best))
    assert found >= 0.9 * 5 * len(asked)


def test_contaminated(spark, sf, docs):
    rows = q.op3_spaced_seeds(spark, sf).collect()
    items = {r.item_id: r.text for r in read_table(spark, sf, "benchmark").collect()}

    def split(text):
        return np.array([hash(w) for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w] or [0])

    wanted, all_words = set(), {i: split(t) for i, t in docs.items()}
    for j, text in items.items():
        b = split(text)
        width = min(len(b), 13)
        for i, h in all_words.items():
            padded = np.concatenate([np.full(len(b), -1), h, np.full(len(b), -1)])
            same = np.lib.stride_tricks.sliding_window_view(padded, len(b)) == b
            runs = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1)
            if len(b) >= 8 and (runs[:, width:] - runs[:, :-width]).max() >= 0.75 * width:
                wanted.add((i, j))
    assert {(r.doc_id, r.item_id) for r in rows} == wanted


@pytest.mark.parametrize("query,label,least", [
    ("op4_weak_supervision", "toxic", 0.9), ("op6_factorization_machine", "quality", 0.95)])
def test_held_out_labels(spark, query, label, least):
    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: r[label] for r in read_table(spark, sf, "labels").collect()}
    rows = [r for r in q.queries()[query](spark, sf).collect() if r.held_out and r.doc_id in known]
    assert len(rows) > 50
    assert sum(r.predicted == known[r.doc_id] for r in rows) >= least * len(rows)
    split, left = (3, 1) if label == "toxic" else (4, 2)
    assert all(zlib.crc32(str(r.doc_id).encode()) % split == left for r in rows)


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: r.lang for r in read_table(spark, sf, "documents").collect()}
    rows = [r for r in q.op7_language(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == known[r.doc_id] for r in rows) >= 0.97 * len(rows) > 0


def test_pieces_equal_the_library(spark, sf, docs):
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=MODEL), PieceEncoder(read_model(MODEL))
    rng = random.Random(1)
    texts = ["", " ", "\n", "▁", "▁▁ x", "<s> hi </s><0x41>", "\x00ab", "日本語👩‍👩‍👧", "a" * 300, "the" * 100,
             " " * 40 + "x" + " " * 17, "\t\ttab", "é̀ ß ſ K"]
    texts += ["".join(rng.choice("ab th e▁ \n<>é日ñ1290'\"().,;in er on") for _ in range(rng.randrange(40))) for _ in range(2000)]
    for text in texts:
        ids, decoded = encoder.encode(text)
        assert np.frombuffer(ids, np.int32).tolist() == library.encode(text), text
        assert decoded == library.decode(library.encode(text))
    rows = {r.doc_id: r for r in q.op5_pieces(spark, sf).collect()}
    for i, text in docs.items():
        ids = library.encode(text or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_licenses(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = con.execute(base_sql())
    names = [d[0] for d in cur.description]
    wanted = {r[0]: dict(zip(names, r)) for r in cur.fetchall()}
    rows = q.op8_licenses(spark, sf).collect()
    assert len(rows) == len(wanted)
    for r in rows:
        assert {n: r[n] for n in names} == wanted[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_licenses_by_notice(spark):
    notices = {
        "mit": "Foo bar. Released under the MIT License. baz", "apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "cc-by,cc-by-nc": "Licensed under CC BY-NC 4.0.", "reserved": "ALL RIGHTS RESERVED", "": "the license of the work is free"}
    filler = [(100 + n, "the of and in a is with to " * 5) for n in range(20)]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(notices.values())] + filler, "doc_id long, text string")
    from affinity.llm.licenses import scan_licenses
    labels = {r.doc_id: r.labels for r in scan_licenses(docs).collect()}
    assert [labels[n] for n in range(len(notices))] == list(notices)


def test_scores_of_the_trie(spark, sf, docs):
    one, two, heads = collections.Counter(), collections.Counter(), collections.Counter()
    tokens = {i: words(t) + [b""] for i, t in docs.items()}
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            one.update(w)
            two.update(zip([b"\n"] + w[:-1], w))
            heads.update([b"\n"] + w[:-1])
    after = collections.Counter(a for a, _ in two)
    total, distinct = sum(one.values()), len(one)
    for r in q.op9_trie_lm(spark, sf).collect():
        w = tokens[r.doc_id]
        single = [(one[x] + 0.5) / (total + 0.5 * (distinct + 1)) for x in w]
        assert r.base_score == pytest.approx(sum(map(math.log10, single)), rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(one[x] > 0 for x in w), total)
        full = sum(math.log10(
            max(two[a, x] - 0.75, 0) / heads[a] + 0.75 * after[a] / heads[a] * p if heads[a] else p)
            for a, x, p in zip([b"\n"] + w[:-1], w, single))
        assert abs(r.score - full) <= 0.025 * len(w)  # half a step of 1/24 decade each


def test_monotone_sequences():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1 << 61), (5, 10), (1000, 1 << 50), (1000, 900), (70_000, 1 << 60)):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        coded = EliasFano.of(values)
        asked = np.concatenate([values, rng.integers(0, top, 500).astype(np.uint64), np.array([top, top + 5], np.uint64)])
        at = np.searchsorted(values, asked)
        there = at < n
        there[there] &= values[at[there]] == asked[there]
        assert (coded.find(asked) == np.where(there, at, -1)).all()
        assert (coded.get(np.arange(n)) == values).all()


def test_chains_keep_order():
    frags = np.array([[0, 100, 10], [12, 112, 10], [5, 300, 6], [30, 129, 8], [50, 10, 9]])
    assert chains(frags)[0] == [0, 1, 3]


def test_repeated_passages(spark, sf, docs):
    rows = q.op10_chaining(spark, sf).collect()
    covered = {i: bytearray(len(words(t))) for i, t in docs.items()}
    for r in rows:
        assert r.other_id < r.doc_id and r.n_words >= 50 and r.n_equal >= 0.75 * r.n_words
        covered[r.doc_id][r.start_word:r.start_word + r.n_words] = b"\1" * r.n_words
    first = {}
    for i in sorted(docs):
        w = words(docs[i])
        for at in range(len(w) - 49):
            run = tuple(w[at:at + 50])
            if first.setdefault(run, i) < i:
                assert 0 not in covered[i][at:at + 50], (i, at)


def test_repeated_passages_with_changes(spark):
    passage = cases.prose(80, 90)
    rows = [(n, " ".join(cases.prose(100, 91 + n) + (passage if n == 1 else cases.changed(passage, 13)) + cases.prose(70, 191 + n)))
            for n in range(1, 5)]
    rows.append((9, " ".join(cases.prose(200, 99))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in repeated_passages(frame).collect()}
    assert sorted(found) == [2, 3, 4] and {r.other_id for r in found.values()} <= {1, 2}
    assert all(abs(r.start_word - 100) <= 13 and r.n_words >= 66 for r in found.values())


def test_changed_passages_whose_halves_stand_in_earlier_documents(spark):
    rows = []
    for n in range(20):
        passage = cases.prose(90, 1000 + n)
        parts = (passage[:45], passage[45:], passage, cases.changed(passage, 25))
        rows += [(4 * n + k, " ".join(cases.prose(80, 2000 + 8 * n + k) + part + cases.prose(80, 3000 + 8 * n + k)))
                 for k, part in enumerate(parts)]
    found = collections.Counter()
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.doc_id // 4 == r.other_id // 4
        if r.doc_id % 4 == 3 and r.start_word <= 85 and r.start_word + r.n_words >= 165:
            found[r.doc_id] += 1
    assert len(found) == 20


def test_changed_passages_whose_whole_copy_is_in_the_middle(spark):
    """The first and the last earlier holders of all seeds hold parts only, and no 50 words in a row are equal."""
    rows = []
    for n in range(6):
        passage = cases.prose(90, 1500 + n)
        front, back = passage[:45], passage[45:]
        parts = (front, back, passage, front, back, cases.changed(passage, 25))
        rows += [(6 * n + k, " ".join(cases.prose(80, 12000 + 8 * n + k) + part + cases.prose(80, 13000 + 8 * n + k)))
                 for k, part in enumerate(parts)]
    found = set()
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.doc_id // 6 == r.other_id // 6
        if r.doc_id % 6 == 5 and r.start_word <= 85 and r.start_word + r.n_words >= 165:
            assert r.other_id % 6 == 2
            found.add(r.doc_id)
    assert len(found) == 6


def test_open_words_in_slices(spark, monkeypatch):
    """A line too short for a passage is open in all its documents; slices of the open places change no row."""
    line, rows = cases.prose(44, 1700), []
    for n in range(12):
        passage = cases.prose(90, 1800 + n // 6)
        part = (passage[:45], passage[45:], passage, passage[:45], passage[45:], cases.changed(passage, 25))[n % 6]
        rows.append((n, " ".join(cases.prose(80, 14000 + n) + part + cases.prose(80, 15000 + n) + line + cases.prose(60, 16000 + n))))
    frame = spark.createDataFrame(rows + rows[3:5], "doc_id long, text string")
    whole = sorted(map(tuple, repeated_passages(frame).collect()))
    assert {(r[0], r[1]) for r in whole} >= {(5, 2), (11, 8)}
    monkeypatch.setattr("affinity.llm.passages.OPEN_AT_ONCE", 5)
    monkeypatch.setattr("affinity.llm.passages.MET_AT_ONCE", 20)
    monkeypatch.setattr("affinity.llm.passages.GAP_BLOCKS", 0)
    assert sorted(map(tuple, repeated_passages(frame).collect())) == whole


def test_sketches_of_many_texts_are_those_of_each():
    rng = random.Random(8)
    texts = [b"", b" \t", b" A b  c\x0b\r\n", b"x " * 90, b"a B a b " * 40, b"\xff\xfe q " * 30] + [
        b" ".join(b"w%d" % rng.randrange(size) for _ in range(n)) for n in range(40) for size in (2, 9, 1000)]
    words, sizes = hashes_of(pa.array(texts, pa.binary()))
    each = [WordHashes().of(words_of(t)) for t in texts]
    assert sizes.tolist() == [len(h) for h in each] and words.tolist() == [int(x) for h in each for x in h]
    got = list(zip(*(x.tolist() for x in sketch(words, sizes))))
    assert got == [(n, *s) for n, h in enumerate(each) for s in zip(*(x.tolist() for x in seed_places(h)))]


def test_maxima_of_the_fenwick_tree():
    rng, tree, held = random.Random(3), Fenwick(37), {}
    for _ in range(3000):
        rank = rng.randrange(37)
        if rank in held:
            del held[rank]
            tree.drop(rank)
        else:
            held[rank] = (rng.random() + 0.1, rank)
            tree.put(rank, held[rank])
        low = rng.randrange(38)
        high = rng.randrange(low, 38)
        assert tree.between(low, high) == max((v for k, v in held.items() if low <= k < high), default=(0.0, -1))


def test_pipeline(spark, sf, docs):
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert 0 < len(rows) < len(docs)
    leaked = {r.doc_id for r in q.op3_spaced_seeds(spark, sf).collect()}
    duplicates = {r.doc_id for r in q.op2_minhash(spark, sf).collect() if not r.kept}
    toxic = {r.doc_id for r in q.op4_weak_supervision(spark, sf).collect() if r.predicted}
    assert not rows.keys() & (toxic | leaked - duplicates)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    same = [i for i in rows if rows[i].n_tokens == len(library.encode(docs[i]))]
    assert len(same) > 0.8 * len(rows)
