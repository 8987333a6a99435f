"""Whole-job tests: each holds an operator against a rule that knows nothing of its method."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_texts import lined, prose
from pyspark.sql import functions as F
from test_brute_force import brute_classes, plain_distance

from vectide.llm import line_dedup, near_dedup, quality


# 7 -----------------------------------------------------------------------------------------------------------
def brute_passages(corpus):
    """Marks, for each pair of places with the same line, the longest run of equal lines from there on, up to its last line with words."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    key = lambda i, t: (-(1 << 62) if i is None else i, signed(xxhash.xxh64_intdigest((t or "").encode(), 42)))
    docs = sorted({(key(i, t), t) for i, t in corpus if t is not None})
    lines = [t.split("\n") for _, t in docs]
    places, gone = defaultdict(list), defaultdict(set)
    for d, own in enumerate(lines):
        for i, x in enumerate(own):
            if not x.strip():
                continue
            for e, j in places[x]:
                n, most = 0, i - j if e == d else len(own)
                while n < most and i + n < len(own) and j + n < len(lines[e]) and own[i + n] == lines[e][j + n]:
                    n += 1
                while not own[i + n - 1].strip():
                    n -= 1
                if sum(bool(y.strip()) for y in own[i : i + n]) > 1:
                    gone[docs[d][0]].update(range(i, i + n))
            places[x].append((d, i))
    out = Counter()
    for i, t in corpus:
        drop = gone[key(i, t)] if t is not None else ()
        out[i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop), len(drop)] += 1
    return out


def test_repeated_passages(spark, documents, corpus):
    rng = random.Random(11)
    shared = lined(prose(rng, 90)).split("\n")
    few = [(200 + n, "\n".join([f"own {n}", *shared[n : n + 2 + n % 4], f"end {n}"])) for n in range(7)]
    few += [(210, "a\na\na"), (211, "a\na\na\na\na"), (212, "x\n\n \ny\n\nx\n\n \ny"), (213, "x\n\ny\nz"), (214, "z\n\n\nown\nx"), (215, "\n\n")]
    few += [(None, "\n".join(["null", *shared[6:8]])), (-5, "\n".join([*shared[8:10], "less"]))] * 2
    for d, docs in ((spark.createDataFrame(few, "doc_id long, text string").repartition(3), few), (documents, corpus)):
        got = line_dedup.dedupe_lines(d, keep=["doc_id"]).collect()
        want = brute_passages(docs)
        assert Counter((r.row.doc_id, r.text, r.n_removed) for r in got) == want
        assert sum(x[2] > 0 for x in want) > 5
    assert line_dedup.dedupe_lines(documents.where("false")).count() == 0


def test_passages_of_two_lines_go_from_the_query(spark, tmp_path):
    """Passages of two to five lines: chunk boundaries met only few of them."""
    from vectide.llm import queries

    rng = random.Random(2)
    passages = [lined(prose(rng, 9 * rng.randint(2, 5))) for _ in range(30)]
    rows = [(n, "\n".join([lined(prose(rng, 30)), p, lined(prose(rng, 30))])) for n, p in enumerate(passages * 2)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_removed for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {n: 0 if n < 30 else len(passages[n - 30].split("\n")) for n in range(60)}


# 8 -----------------------------------------------------------------------------------------------------------
def last_two(make):
    """The two of 300 variants with the greatest MD5, which are never the head of a bucket that holds any other text."""
    return sorted((make(i) for i in range(300)), key=lambda t: hashlib.md5(t.encode()).digest())[-2:]


@pytest.mark.parametrize("block", [256, 8])
def test_no_link_is_lost_in_a_much_quoted_passage(spark, monkeypatch, block):
    """Two near copies that consist of the passage: in every bucket they share, the head is a text too long to be near."""
    monkeypatch.setattr(near_dedup, "_BLOCK", block)
    quoted = random.Random(4).sample([f"w{i}" for i in range(400)], 100)
    own = lambda i: [f"own{i}x{k}" for k in range(14)]
    texts = [" ".join([*own(i), *quoted, *own(i + 500)]) for i in range(60)]
    texts += last_two(lambda i: " ".join([*quoted, f"added{i}"]))
    docs = list(enumerate(texts))
    got = near_dedup.label_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    want = brute_classes(docs)
    assert (61, 60) in want
    assert {(r.doc_id, r.class_id) for r in got.collect()} == want


def test_bags_exclude_no_similar_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 40, 60).astype(np.uint64)
    texts = []
    for edits in range(40):
        t = base.copy()
        t[rng.choice(60, edits % 20, replace=False)] = rng.integers(0, 60, edits % 20)
        texts.append(near_dedup.mix(np.delete(t, rng.choice(60, edits % 7, replace=False))))
    n = np.array([len(t) for t in texts])
    yes, side = np.ones(len(n), dtype=bool), np.zeros(len(n), dtype=bool)
    bags = [near_dedup.word_bag(t).tobytes() for t in texts]
    found = {(int(i), int(j)) for i, j, _ in zip(*near_dedup.possible_pairs(n, bags, np.arange(len(n)), yes, side, 0.8), strict=True)}
    near = {(i, j) for j in range(len(n)) for i in range(j) if plain_distance(texts[i].tolist(), texts[j].tolist()) <= 0.2 * max(n[i], n[j]) + 1e-9}
    assert near and near <= found and len(found) < len(n) * (len(n) - 1) / 2


def test_a_group_with_a_null_id_keeps_one_document(spark):
    rng = random.Random(9)
    texts = [prose(rng, 60) for _ in range(3)]
    near = [" ".join([*t[:30], "changed", *t[31:]]) for t in texts]
    rows = [(None, " ".join(texts[0])), (7, near[0]), (3, " ".join(texts[1])), (None, near[1]), (None, " ".join(texts[2])), (None, near[2])]
    kept = near_dedup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 3), (False, 7), (True, 0)]
    assert {(r.doc_id, r.text) for r in kept if r.doc_id} == {rows[1], rows[2]}


def test_members_of_a_large_group_meet_the_others(spark, monkeypatch):
    """A bucket's greatest group, dealt into lots, and the few texts outside it, one of which is near to some of its members only."""
    monkeypatch.setattr(near_dedup, "_BLOCK", 4)
    monkeypatch.setattr(near_dedup, "_LOT", 3)
    rng = random.Random(6)
    base = prose(rng, 100)
    texts = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(40)]
    far = [*base[:55], *prose(rng, 17), *base[72:]]
    texts += [" ".join(far), " ".join([*far[:10], *prose(rng, 12), *far[22:]]), " ".join(prose(rng, 100))]
    docs = list(enumerate(texts))
    got = near_dedup.label_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert {(r.doc_id, r.class_id) for r in got.collect()} == brute_classes(docs)


def test_texts_before_a_cut_count_too(spark):
    rng = random.Random(8)
    lines = [" ".join(prose(rng, 20)) for _ in range(6)]
    copy = [*lines[:3], *[f"changed {x}" for x in lines[3:]]]
    other = " ".join(prose(rng, 60))
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(copy[3:])), (3, other), (None, None)], "doc_id long, text string")
    earlier = spark.createDataFrame([("\n".join(copy[3:]), "\n".join(copy)), (other, other)], "text string, before string")
    ids = lambda df: sorted((r.doc_id or 0) for r in df.collect())
    assert ids(near_dedup.without_near_duplicates(docs)) == [0, 1, 2, 3]
    assert ids(near_dedup.without_near_duplicates(docs, earlier=earlier)) == [0, 1, 3]
    assert ids(near_dedup.without_near_duplicates(docs, earlier=earlier.where("false"))) == [0, 1, 2, 3]


def test_every_label_of_its_half_sets_the_threshold(spark, monkeypatch):
    n, seen = 42_000, []
    threshold = quality.score_threshold
    monkeypatch.setattr(quality, "score_threshold", lambda scored, **how: seen.append(scored.count()) or threshold(scored, **how))
    docs = spark.range(n).selectExpr("id as doc_id", "repeat(concat('word', id % 7, ' '), 20) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 10 > 0 as int) as quality")
    half = quality._labelled(labels, "doc_id", "quality").where("not fit").count()
    assert half > 20_000
    assert quality.judge_quality(docs, labels, buckets=1 << 10).count() == n
    assert seen == [half]
    small = quality.judge_quality(docs.where("doc_id < 50").withColumn("doc_id", F.expr("cast(doc_id as int)")), labels, buckets=1 << 10)
    assert small.count() == 50  # ids of another type than those of the labels
    assert seen[1:] == [quality._labelled(labels, "doc_id", "quality").where("not fit and id < 50").count()]


def test_plans_do_not_spell_out_the_weights(spark):
    docs = spark.createDataFrame([(i, " ".join(["some", "words"] * 20)) for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    assert len(quality.judge_quality(docs, labels)._jdf.queryExecution().toString()) < 1_000_000


def test_of_two_groups_the_nearest_pair_leaves_a_bucket():
    groups = np.array([0] * 40 + [1] * 40 + [2])
    rng = np.random.default_rng(8)
    bags = [near_dedup.word_bag(rng.integers(1, 1 << 60, 100).astype(np.uint64)).tobytes()] * len(groups)
    n, home, side = np.full(len(groups), 100), np.ones(len(groups), dtype=bool), np.zeros(len(groups), dtype=np.int64)
    pairs = near_dedup.possible_pairs(n, bags, groups, home, side, 0.8)
    assert len(pairs[0]) == 40 * 40 + 2 * 40
    i, j, _ = near_dedup.nearest_pairs(*pairs, groups)
    assert sorted((int(groups[x]), int(groups[y])) for x, y in zip(i, j, strict=True)) == [(0, 1), (0, 2), (1, 2)]
    assert [len(x) for x in near_dedup.nearest_pairs(*(np.zeros(0, dtype=np.int64),) * 3, groups)] == [0, 0, 0]


def test_pairs_that_are_not_near_stay_in_their_task(spark, monkeypatch):
    """Texts of one passage and the same other words in any order: every pair of a bucket is possible, and none is near."""
    rng, made, step = random.Random(5), [], near_dedup.map_arrow
    passage, others = prose(rng, 60), [f"o{i}" for i in range(60)]
    docs = [(i, " ".join([*passage, *rng.sample(others, 60)])) for i in range(160)]

    def counted(df, run, schema):
        rows = spark.sparkContext.accumulator(0)
        made.append(rows)

        def own(batches):
            for b in run(batches):
                rows.add(b.num_rows)
                yield b

        return step(df, own, schema)

    monkeypatch.setattr(near_dedup, "map_arrow", counted)
    got = near_dedup.label_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert {(r.doc_id, r.class_id) for r in got.collect()} == {(i, i) for i in range(160)}
    assert max(x.value for x in made) <= 60 * len(docs) < 160 * 159 / 2  # a text has 60 sketches


@pytest.mark.parametrize("words", [1 << 17, 150])
def test_tiles_lose_no_link(spark, monkeypatch, words):
    for name, x in (("_BLOCK", 8), ("_PART", 3), ("_PART_WORDS", words)):
        monkeypatch.setattr(near_dedup, name, x)
    rng = random.Random(7)
    passage, own = prose(rng, 60), [prose(rng, 9) for _ in range(8)]
    docs = [(i, " ".join([*own[rng.randrange(8)], *passage, *rng.choice(own)[: rng.randrange(10)]])) for i in range(60)]
    got = near_dedup.label_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert {(r.doc_id, r.class_id) for r in got.collect()} == brute_classes(docs)


def test_a_pair_is_settled_in_the_first_bucket_it_shares():
    rng = np.random.default_rng(4)
    lists = [np.unique(rng.integers(-900, 900, 40)) for _ in range(50)]
    owners, i, j = np.repeat(np.arange(50), [len(x) for x in lists]), *np.triu_indices(50, 1)
    times = np.zeros(len(i), dtype=int)
    for s in np.unique(np.concatenate(lists)):
        both = np.array([s in lists[a] and s in lists[b] for a, b in zip(i, j, strict=True)])
        times[both] += ~near_dedup.met_before(s, owners, np.concatenate(lists), i[both], j[both])
    assert (times == [len(np.intersect1d(lists[a], lists[b])) > 0 for a, b in zip(i, j, strict=True)]).all()
    none = np.zeros(0, dtype=np.int64)
    assert len(near_dedup.met_before(5, none, none, none, none)) == 0


def test_a_tile_gives_fewer_links_than_groups():
    groups, i, j = np.arange(30) // 2, *np.triu_indices(30, 1)
    other = groups[i] != groups[j]
    pairs, compared = (i[other], j[other], np.abs(i - j)[other]), []

    def near(x, y):
        compared.append((x, y))
        return groups[x] % 3 == groups[y] % 3

    links = near_dedup.tile_links(groups, pairs, near)
    assert len(links) == 12 and len(set(compared)) == len(compared)
    assert near_dedup.parts_of(np.array([1, 1, 1, 50, 900, 1]), 3, 100).tolist() == [0, 0, 0, 1, 1, 10]
