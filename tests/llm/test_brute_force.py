from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_texts import lined, prose
from pyspark.sql import functions as F

from vectide.llm import decontaminate, licenses, line_dedup, near_dedup, packing, quality, token_counts
from vectide.llm.common import shingles, word_hashes, words
from vectide.llm.tokens import default_vocab, encoder

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


@given(st.text())
@settings(max_examples=200, deadline=None)
def test_words_and_their_hashes(text):
    assert [w.decode() for w in words(text)] == plain_words(text)
    h = word_hashes(text)
    assert len(h) == len(plain_words(text))
    assert all((x == y) == (a == b) for a, x in zip(plain_words(text), h, strict=True) for b, y in zip(plain_words(text), h, strict=True))


def test_hashes_of_long_texts_do_not_depend_on_pieces():
    w = [f"w{i % 977}é" for i in range(200_000)]
    h = word_hashes(" ".join(w))
    assert len(h) == len(w) and len(set(h.tolist())) == 977 and (h[:977] == h[977 : 2 * 977]).all()
    assert len(shingles(h, 5)) == len(w) - 4 and len(shingles(h[:3], 5)) == 0


# 1 -----------------------------------------------------------------------------------------------------------
def test_token_counts(spark, documents, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocab())
    n = Counter(len(t.encode(x, add_special_tokens=False).ids) for _, x in corpus if x is not None)
    h = token_counts.length_histogram(documents)
    assert {r.length: r.n_docs for r in h.collect()} == n
    lengths = sorted(n.elements())
    sums = token_counts.suffix_sums(h)
    for r in sums.collect():
        assert r.docs_ge == sum(x >= r.length for x in lengths) and r.docs_le == sum(x <= r.length for x in lengths)
        assert r.tokens_ge == sum(x for x in lengths if x >= r.length) and r.n_tokens == r.length * n[r.length]
        assert r.truncated_tokens == sum(min(x, r.length) for x in lengths)
    for limit in (0, 1, 100, lengths[len(lengths) // 2] + 1, 10**6):
        r = token_counts.truncated_total(sums, limit).first()
        assert (r.docs, r.tokens, r.truncated_tokens, r.cut_docs) == (len(lengths), sum(lengths), sum(min(x, limit) for x in lengths), sum(x > limit for x in lengths))
    for share in (0.01, 0.5, 1.0):
        assert token_counts.length_quantile(sums, share).first().length == lengths[math.ceil(share * len(lengths)) - 1]
    empty = token_counts.length_histogram(documents.where("false"))
    assert token_counts.suffix_sums(empty).count() == 0 and token_counts.truncated_total(token_counts.suffix_sums(empty), 5).first().tokens == 0


def test_encoder_equals_the_vocabulary_file():
    """With the library's defaults, also around the length at which the library changes."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocab())
    encode = encoder()
    texts = ["", "Hello  world\n\n", "é" * 50, "<|endoftext|> a", "a<|endoftext|><|endoftext|>b <|endoftext", " \t\r\n", "日本語 😀", " " * 30000 + "x", "\u00a0 \u2003\u3000a\u2028 b\u0085"]
    texts += [x * n for x in ("a", " ", "\n", "é", "\u3000", "ab,") for n in (6666, 19_999, 20_000)]
    for x in texts:
        assert list(encode(x)) == t.encode(x, add_special_tokens=False).ids
    assert list(encode("<|endoftext|>")) == [50256]


@given(st.lists(st.one_of(st.text(), st.sampled_from(["<|endoftext|>", "<|", " \u00a0", "\r\n", "\u2003", "don't", "1234"])), max_size=8))
@settings(max_examples=200, deadline=None)
def test_encoder_equals_the_vocabulary_file_on_any_text(parts):
    from tokenizers import Tokenizer

    if not hasattr(test_encoder_equals_the_vocabulary_file_on_any_text, "pair"):
        test_encoder_equals_the_vocabulary_file_on_any_text.pair = Tokenizer.from_file(default_vocab()), encoder()
    plain, encode = test_encoder_equals_the_vocabulary_file_on_any_text.pair
    text = "".join(parts)
    assert list(encode(text)) == plain.encode(text, add_special_tokens=False).ids


# 2 -----------------------------------------------------------------------------------------------------------
def test_license_scans(spark):
    mit, apache = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["Apache-2.0"][1]
    pad = " ".join(f"word{i}" for i in range(900))
    changed = mit.replace("merge", "combine")
    texts = [
        f"{pad} {mit} {pad}", f"{pad} {changed}", "Released under the MIT License.", f"{pad} released UNDER the mit license {pad}", pad, None, "",
        "MIT License", f"{apache} {pad} {mit}", " ".join(mit.split()[:20]), "licensed under the GNU General Public License, version 3",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_report(docs).collect()}
    assert [got[i].licenses for i in range(len(texts))] == ["MIT", "MIT", "MIT", "MIT", "", "", "", "", "Apache-2.0,MIT", "", "GPL-3.0"]
    assert got[0].contained == 1.0 and 0.8 <= got[1].contained < 1.0 and got[4].contained is None


def test_license_windows_find_every_planted_template(spark):
    import random

    rng = random.Random(3)
    flat = [(name, t) for name, ts in licenses.TEMPLATES.items() for t in ts]
    docs, want = [], {}
    for i in range(300):
        name, t = rng.choice(flat)
        pre, post = rng.randrange(300), rng.randrange(300)
        docs.append((i, " ".join([*(f"a{rng.randrange(9999)}" for _ in range(pre)), t, *(f"b{rng.randrange(9999)}" for _ in range(post))])))
        want[i] = (name, pre)
    got = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), keep=["doc_id"])
    for r in got.collect():
        assert any(m.license == want[r.row.doc_id][0] and abs(m.start - want[r.row.doc_id][1]) <= 1 and m.contained == 1.0 for m in r.res.matches)
    assert licenses.bands_needed(0.5, 0.9999) == 14 and licenses.bands_needed(1.0, 0.9999) == 1


def brute_licenses(text, templates, contained=0.8):
    """Every stretch of the text that holds enough of a template's shingles in their order, best first, without overlaps."""
    w, out = plain_words(text), set()
    text_grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    for name, versions in templates.items():
        for k, version in enumerate(versions):
            v = plain_words(version)
            grams = [tuple(v[i : i + 5]) for i in range(len(v) - 4)]
            need, finds = math.ceil(contained * len(set(grams)) - 1e-9), []
            for start in (i for i, g in enumerate(text_grams) if g in grams):
                for end in range(start, min(len(text_grams), start + 2 * len(grams))):
                    held = [grams.index(g) for g in text_grams[start : end + 1] if g in grams]
                    if text_grams[end] in grams and len(held) >= need and held == sorted(set(held)):
                        finds.append((-len(held), start, end))
            taken = []
            for n, a, b in sorted(finds, key=lambda f: (f[0], f[2] - f[1], f[1])):
                if all(b + 5 <= x or y <= a for x, y in taken):
                    taken.append((a, b + 5))
                    out.add((name, k, a, b + 5))
    return out


def test_every_copy_of_a_template_is_listed(spark):
    import random

    rng = random.Random(4)
    templates = {"A": (" ".join(f"a{i}" for i in range(70)), " ".join(f"s{i}" for i in range(5))), "B": (" ".join(f"b{i}" for i in range(24)),)}
    docs = [(0, None), (1, ""), (2, "a1 a2")]
    for i in range(3, 60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            v = rng.choice([*templates["A"], *templates["B"]]).split()
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = "changed"
            cut = rng.randint(0, len(v) // 8)
            parts += [*v[cut:], *(f"x{rng.randrange(999)}" for _ in range(rng.choice((0, 0, 3, 40))))]
        docs.append((i, " ".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit(1), "res": F.lit(2), "matches": F.lit(3)})
    got = {r.row.doc_id: {(m.license, m.template, m.start, m.end) for m in r.res.matches} for r in licenses.scan_licenses(df, templates=templates).collect()}
    assert got == {i: brute_licenses(t, templates) for i, t in docs} and sum(len(x) > 1 for x in got.values()) > 10
    mit = licenses.TEMPLATES["MIT"][2]
    two = licenses.scan_licenses(spark.createDataFrame([(1, f"{mit} {mit}")], "doc_id long, text string"), templates={"MIT": (mit,)}).first()
    assert [(m.start, m.end) for m in two.res.matches] == [(0, 87), (87, 174)]
    assert licenses.scan_licenses(df.where("false")).count() == 0


# 3 -----------------------------------------------------------------------------------------------------------
def brute_contamination(text, items, size=13):
    w, hit, found = plain_words(text), set(), set()
    for key, t in items:
        x = plain_words(t)
        for i in range(max(1, len(x) - size + 1) if x else 0):
            win = x[i : i + size]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    found |= {str(key)} if key is not None else set()
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [1_000_000, 40])
def test_decontamination(spark, documents, corpus, block_words):
    long = plain_words(corpus[62][1])
    items = [
        (1, " ".join(long[10:40])), (2, " ".join(long[70:84])), (10, "The re"), (3, None), (4, ""), (5, "!!!"), (6, " ".join(long[10:40])), (None, " ".join(long[100:120])),
        (7, "never seen words here"), (8, "the the the the the the the the the the the the the the the"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = documents.where("doc_id <> 95 or doc_id is null")
    got = decontaminate.contamination_report(small, bench, block_words=block_words).collect()
    want = Counter()
    for i, t in corpus:
        if i == 95:
            continue
        n, hit, found = brute_contamination(t, items)
        want[(i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n)] += 1
    assert Counter(map(tuple, got)) == want
    kept = decontaminate.without_contaminated(small, bench, block_words=block_words)
    assert kept.columns == small.columns and kept.count() == sum(c for k, c in want.items() if not k[5])


def test_decontamination_of_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination_report(documents, none).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.contamination_report(documents.where("false"), none).count() == 0


# 6 -----------------------------------------------------------------------------------------------------------
def brute_base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = [line for line in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    where = defaultdict(list)
    for i in range(len(w) - 7):
        where[tuple(w[i : i + 8])].append(i)
    rep = {p for at in where.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(seen) - len(set(seen)), len(rep), failed


def test_quality_base_counts(spark):
    texts = [
        None, "", "  ", "one", " lead  and\ttail \n", "a b c d e f g h a b c d e f g h", "x " * 500, "l1 a\nl1 a\n\n \nl2\nl1 a", "# * $ % & | < > ### é☃",
        " ".join(f"w{i}" for i in range(30)), " nbsp stays   word", " ".join(f"w{i % 11}" for i in range(100)), "a b c d e f g h i " * 3 + "z",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: tuple(r.base) for r in quality.base_counts(docs, keep=["doc_id"]).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}


def test_quality_base_counts_of_the_corpus(documents, corpus):
    got = Counter((r.row.doc_id, *r.base) for r in quality.base_counts(documents, keep=["doc_id"]).collect())
    assert got == Counter((i, *brute_base(t)) for i, t in corpus)


def brute_scores(docs, good, buckets):
    import xxhash

    def h(x):
        return xxhash.xxh64_intdigest(x.encode(), 42)

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        ends = [h(x[-2:]) for x in w]
        pairs = [(a ^ (signed(b) >> 1)) & (buckets - 1) for a, b in zip(ends, ends[1:], strict=False)]
        return [h(x) & (buckets - 1) for x in w] + pairs

    raw, trusted = Counter(), Counter()
    for i, t in docs:
        raw.update(grams(t))
        if i in good:
            trusted.update(grams(t))
    n, m = sum(raw.values()) + buckets, sum(trusted.values()) + buckets
    weight = lambda b: math.log((trusted[b] + 1) / m) - math.log((raw[b] + 1) / n)
    return [sum(map(weight, g)) / len(g) if (g := grams(t)) else 0.0 for _, t in docs]


def test_quality_verdicts(spark):
    import random

    rng = random.Random(5)
    clean = [(i, lined(prose(rng, 80))) for i in range(60)]
    shout = [(i, " ".join(x.upper() + "!!" for x in prose(rng, 80))) for i in range(60, 90)]
    docs = [*clean, *shout, (200, None), (201, "short")]
    labels = [(i, 1) for i in range(0, 60, 2)] + [(i, 0) for i in range(60, 90, 3)] + [(None, 1), (1, None), (4, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.row.doc_id: r for r in quality.judge_quality(d, lab, buckets=1 << 10).collect()}
    fit = {r.id for r in quality._labelled(lab, "doc_id", "quality").where("good and fit").collect()}
    assert 5 < len(fit) < 25
    want = brute_scores(docs, fit, 1 << 10)
    assert all(abs(got[i].score - s) < 1e-9 for (i, _), s in zip(docs, want, strict=True))
    assert {i for i, r in got.items() if r.kept} == {i for i, t in clean if not brute_base(t)[-1]}
    nothing = quality.judge_quality(d, lab.where("false"), buckets=1 << 10).where("kept = base.base_failed")
    assert nothing.count() == 0
    assert quality.judge_quality(d.where("false"), lab).count() == 0


# 7 -----------------------------------------------------------------------------------------------------------
def brute_lines(corpus, window=2, spread=4):
    """Chunk by chunk, with the polynomial of each window summed anew."""
    import xxhash

    base = 0x9E3779B97F4A7C15
    key = lambda i, t: (-(1 << 62) if i is None else i, xxhash.xxh64_intdigest((t or "").encode(), 42))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    docs = {(k[0], signed(k[1])): t for i, t in corpus if t is not None for k in [key(i, t)]}
    chunks = defaultdict(list)
    for k, t in sorted(docs.items()):
        lines = t.encode().split(b"\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        h = [xxhash.xxh3_64_intdigest(lines[i]) for i in full]
        roll = [sum(x * base ** (n - m) for m, x in enumerate(h[: n + 1]) if n - m < window) % (1 << 64) for n in range(len(h))]
        ends = sorted({*full[:1], *full[-1:], *(i for i, r in zip(full, roll, strict=True) if (r >> 32) % spread == 0)})
        for a, b in zip(ends, ends[1:], strict=False):
            chunks[b"\n".join(lines[a : b + 1])].append((k, a, b + 1))
    gone = defaultdict(set)
    for at in chunks.values():
        first = min(at)
        for k, a, b in at:
            if k != first[0] or a >= first[2]:
                gone[k].update(range(a, b))
    out = []
    for i, t in corpus:
        k = key(i, t)
        drop = gone.get((k[0], signed(k[1])), set()) if t is not None else set()
        out.append((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop), len(drop)))
    return out


@pytest.mark.parametrize(("window", "spread"), [(2, 1), (2, 4), (3, 2)])
def test_line_dedup(documents, corpus, window, spread):
    got = line_dedup.dedupe_lines(documents, keep=["doc_id"], window=window, spread=spread).collect()
    want = brute_lines(corpus, window, spread)
    assert sum(x[2] > 0 for x in want) > 5
    assert Counter((r.row.doc_id, r.text, r.n_removed) for r in got) == Counter(want)
    assert line_dedup.dedupe_lines(documents.where("false")).count() == 0


def test_line_dedup_compares_bytes(documents, corpus, monkeypatch):
    """With a hash that always collides the result is the same, as texts are then grouped by their bytes."""
    keyed = documents.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t")).alias("key"), "text")
    plain = {tuple(map(str, r)) for r in line_dedup.repeated_chunks(keyed).distinct().collect()}
    real = line_dedup._chunks
    monkeypatch.setattr(line_dedup, "_chunks", lambda *a: real(*a).withColumn("h", F.lit(b"same")))
    assert {tuple(map(str, r)) for r in line_dedup.repeated_chunks(keyed).distinct().collect()} == plain and plain


def test_chunks_resynchronise():
    lines = [f"line {i}".encode() for i in range(300)]
    for spread in (1, 4):
        a = line_dedup.boundaries(lines, 2, spread)
        b = line_dedup.boundaries([b"one", b"more", b"", b"start", *lines], 2, spread)
        assert [x + 4 for x in a if x > 2] == [x for x in b if x > 6]


def test_recall_by_passage_length():
    """A passage in two otherwise unrelated texts: the share of its lines that lie in chunks common to both."""
    import random

    rng, share = random.Random(3), {}
    new = lambda n: [f"{rng.random()} {rng.random()}".encode() for _ in range(n)]
    for spread in (1, 2, 4):
        for n in (2, 4, 8, 16, 32):
            found = 0
            for _ in range(200):
                passage, sets = new(n), []
                for _ in range(2):
                    lines = [*new(5), *passage, *new(5)]
                    sets.append({b"\n".join(lines[a:b]): (a - 5, b - 5) for a, b in line_dedup.chunk_ranges(lines, 2, spread)})
                found += len({i for c in sets[0].keys() & sets[1].keys() for i in range(*sets[0][c])})
            share[spread, n] = found / 200 / n
    assert all(share[1, n] == 1.0 for n in (2, 4, 8, 16, 32))
    assert share[4, 4] < share[2, 4] < 0.6 and share[4, 32] > 0.7 and share[2, 32] > 0.85
    print({k: round(v, 2) for k, v in share.items()})


# 8 -----------------------------------------------------------------------------------------------------------
def plain_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40), st.integers(0, 45))
@settings(max_examples=300, deadline=None)
def test_banded_alignment(a, b, most):
    d = plain_distance(a, b)
    got = near_dedup.edit_distance(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), most)
    assert got == (d if d <= most else None)


def test_banded_alignment_over_wide_bands(monkeypatch):
    rng = np.random.default_rng(1)
    for n, edits in ((400, 90), (700, 150)):
        a = rng.integers(0, 10**6, n).astype(np.uint64)
        b = a.copy()
        b[rng.choice(n, edits, replace=False)] = rng.integers(10**6, 10**7, edits).astype(np.uint64)
        b = np.delete(b, rng.choice(n, 20, replace=False))
        d = plain_distance(a.tolist(), b.tolist())
        for bits in (1 << 15, 0):  # 0: what texts too long for bits get
            monkeypatch.setattr(near_dedup, "_BITS", bits)
            assert d > 64 and near_dedup.edit_distance(a, b, d) == d and near_dedup.edit_distance(a, b, d - 1) is None


def brute_classes(corpus, similarity=0.8):
    texts = sorted({t or "" for _, t in corpus})
    h = [word_hashes(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(h[i]) and len(h[j]) and near_dedup.edit_distance(h[i], h[j], int((1 - similarity) * max(len(h[i]), len(h[j])) + 1e-9)) is not None:
                root[find(i)] = find(j)
    group = defaultdict(list)
    for i, t in corpus:
        group[find(texts.index(t or ""))].append(i)
    return {(i, min((x for x in ids if x is not None), default=None)) for ids in group.values() for i in ids}


def test_near_duplicates(documents, corpus):
    got = near_dedup.label_near_duplicates(documents)
    assert got.count() == len(corpus)
    assert {(r.doc_id, r.class_id) for r in got.collect()} == brute_classes(corpus)
    kept = near_dedup.without_near_duplicates(documents)
    assert kept.columns == documents.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(c for c in {c: 0 for _, c in brute_classes(corpus)} if c is not None) + Counter([None])
    assert near_dedup.label_near_duplicates(documents.where("false")).count() == 0


def same(x, y):
    """The share of sketches that two texts have in common."""
    a, b = (near_dedup.order_sketches(near_dedup.labelled_kmers(t, 5), 64, 2) for t in (x, y))
    return len(np.intersect1d(a, b)) / len(np.union1d(a, b))


def test_sketches_see_order_and_repeats():
    a = word_hashes(" ".join(f"w{i}" for i in range(200)))
    moved = np.r_[a[100:], a[:100]]
    assert same(a, a) == 1.0 and 0.1 < same(a, moved) < 0.7
    twice = np.r_[a, a]
    assert same(a, twice) < 0.5
    assert same(a, np.r_[a, a[:20]]) > 0.5  # a first occurrence is labelled alike in texts with and without repeats
    assert len(near_dedup.text_sketches(a[:0], 6, 5)) == 0 and len(near_dedup.text_sketches(a[:2], 6, 5)) == 1
    assert len(near_dedup.text_sketches(a, 6, 5)) == 60


@pytest.mark.parametrize(("words_", "similarity", "least"), [(200, 0.8, 0.88), (200, 0.85, 0.95), (200, 0.9, 0.99), (600, 0.8, 0.88), (60, 0.85, 0.93), (25, 0.8, 0.9), (8, 0.87, 0.9)])
def test_sketches_meet_by_edit_similarity(words_, similarity, least):
    """Scattered substitutions: the share of near pairs that have a bucket in common."""
    rng, met = np.random.default_rng(7), 0
    for _ in range(400):
        a = rng.integers(0, 1 << 60, words_).astype(np.uint64)
        b = a.copy()
        b[rng.choice(words_, int((1 - similarity) * words_ + 1e-9), replace=False)] ^= np.uint64(1 << 61)
        met += len(np.intersect1d(near_dedup.text_sketches(a, 6, 5), near_dedup.text_sketches(b, 6, 5))) > 0
    assert met / 400 >= least


def test_components(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"x", b"y")], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in near_dedup.components(links).collect()}
    assert got == {bytes([i]): b"\0" for i in range(41)} | {b"x": b"x", b"y": b"x"}


# 10 ----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("block_tokens", [2_000_000, 3000])
def test_packing_round_trip(spark, documents, corpus, block_tokens):
    p = packing.pack_documents(documents, with_ids=True, block_tokens=block_tokens, group_windows=4).toPandas()
    encode = encoder()
    want = Counter((i, tuple([*(encode(t) if t else []), 1])) for i, t in corpus)
    windows = p.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, s in windows:
        assert s.offset.tolist() == np.r_[0, s.length.cumsum()[:-1]].astype(int).tolist() and s.length.sum() <= 2048
        assert s.step_group.nunique() == 1
    total = windows.length.sum()
    padding = sum(2048 - n for n in total if n & (n - 1))
    assert padding <= 2048 * documents.rdd.getNumPartitions()
    found = Counter()
    for (i, n), parts in p.fillna({"doc_id": -1}).groupby(["doc_id", "doc_tokens"]):
        by_start = defaultdict(list)
        for r in parts.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, dtype="<u4").tobytes()) and len(r.ids) == r.length
            by_start[r.start].append(tuple(r.ids))
        if len({len(x) for x in by_start.values()}) == 1 and len(by_start[0]) == 1:
            found[(None if i < 0 else i, sum((x[0] for _, x in sorted(by_start.items())), ()))] += 1
    single = {k: c for k, c in want.items() if sum(x[0] == k[0] and len(x[1]) == len(k[1]) for x in want.elements()) == 1}
    assert all(found[k] == 1 for k in single) and len(single) > 80
    assert p.length.sum() == sum(len(k[1]) * c for k, c in want.items())
    assert packing.pack_documents(documents.where("false")).count() == 0
    one = packing.unpacked(packing.pack_documents(documents.where("doc_id < 60 and doc_id <> 3"), with_ids=True))
    assert {(r.doc_id, tuple(r.ids)) for r in one.collect()} == {k for k in want if k[0] is not None and k[0] < 60 and k[0] != 3}


def test_packing_refuses_odd_contexts(documents):
    for context, smallest in ((2000, 256), (2048, 100), (256, 512)):
        with pytest.raises(ValueError):
            packing.pack_documents(documents, context=context, smallest=smallest)


# Extra columns -----------------------------------------------------------------------------------------------
def test_clashing_columns(spark, documents, clashing):
    bench = spark.createDataFrame([(1, "the re an")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1), (94, 0)], "doc_id long, quality int")
    assert decontaminate.without_contaminated(clashing, bench).columns == clashing.columns
    assert quality.judge_quality(clashing, labels).where("kept").select("row.*").columns == clashing.columns
    assert near_dedup.without_near_duplicates(clashing).columns == clashing.columns
    for f in (token_counts.length_histogram, licenses.license_report, near_dedup.label_near_duplicates, packing.pack_documents, line_dedup.dedupe_lines):
        assert f(clashing).count() == f(documents).count()
