"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Byte-equal texts form a class and only classes go on. A class's k-mers (five words) are labelled with their occurrence
number, so a text that repeats one differs from a text that doesn't. Each of ``functions`` hash functions samples
the ``least`` least of them and keeps these in text order; every two of a sample, in that order, are a sketch. Two texts share one only if
their order agrees too, which is what edits keep and shuffled text loses.

Classes that share a sketch and are of near length meet in a bucket. Each is compared with one head of its buckets, which
connects most of what is near. Buckets that still hold unconnected members are settled exactly: of each such pair
whose lengths allow it, the words that only one of them holds bound the distance from below. Members with a partner that these bounds leave go on with their
texts, in tiles of bounded size, and are aligned there, nearest pairs first, until all pairs of a tile are connected or compared. No pair leaves a task: a tile gives the links that join its
groups, fewer than its members, and a pair that shares many buckets is compared in one of them. So no link between two members of a bucket is lost; a near pair that
shares no bucket is. A pair is a near-duplicate if its word-level edit distance, within a band that the threshold
sets, leaves a similarity of ``similarity`` or more. Groups are the connected components of these links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, map_arrow, mix, shingles, stored, word_hashes

_WORDS = 5

#: Texts of _SHORT[1] words at most are sketched by k-mers of three words, those of _SHORT[0] at least by five.
_FEW_WORDS, _SHORT = 3, (20, 30)

#: Words are told apart by hash in so many cells at most, and members of a bucket are compared in blocks of about so many.
_CELLS, _BLOCK = 1 << 16, 1024

#: Members go on to alignment in parts of about so many, or so many words; two parts or one make a tile.
_PART, _PART_WORDS = 256, 1 << 17

#: Alignments walk along diagonals up to so many edits; up to so many words rows are then kept as bits.
_FEW, _BITS = 24, 1 << 15

#: Pairs with one text are dealt out in lots of about so many.
_LOT = 256


def labelled_kmers(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-mer and of how many equal ones stand before it; of the whole text if it is shorter."""
    h = shingles(hashes, k) if len(hashes) >= k else shingles(hashes, max(1, len(hashes)))
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]]
    if not new.all():
        at = np.arange(len(s))
        nth = at - np.maximum.accumulate(np.where(new, at, 0))
        h = h.copy()
        h[order] = np.where(nth > 0, mix(s + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), s)
    return h


def order_sketches(h: np.ndarray, functions: int, least: int) -> np.ndarray:
    """The distinct hashes of two k-mers in text order: of each function's ``least`` least k-mers every two are taken."""
    if len(h) < 2:
        return mix(h)
    least = min(least, len(h))
    seeds = mix(np.arange(1, functions + 1, dtype=np.uint64))
    rows, out = max(1, (1 << 20) // len(h)), []
    first, second = np.triu_indices(least, 1)
    for a in range(0, functions, rows):
        v = (h[None, :] ^ seeds[a : a + rows, None]) * np.uint64(0x9FB21C651E98DF25)
        v ^= v >> np.uint64(32)
        at = np.sort(np.argpartition(v, least - 1, axis=1)[:, :least], axis=1) if least < len(h) else np.arange(len(h))[None, :]
        kept = h[at]
        out.append(mix(mix(kept[:, first]) + kept[:, second]).ravel())
    return np.unique(np.concatenate(out))


def text_sketches(hashes: np.ndarray, functions: int, least: int) -> np.ndarray:
    """The sketches of a text's five-word k-mers, and of shorter ones for a text so short that one edit may touch most of those.

    Any two texts of near lengths (4 to 5) have one kind of sketch in common.
    """
    out = [order_sketches(labelled_kmers(hashes, _WORDS), functions, least)] if len(hashes) >= _SHORT[0] else []
    if len(hashes) <= _SHORT[1]:
        out.append(mix(order_sketches(labelled_kmers(hashes, _FEW_WORDS), functions, least)))
    return np.concatenate(out) if len(hashes) else np.zeros(0, dtype=np.uint64)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word-level Levenshtein distance if it is at most ``most``, else None; only diagonals within that band are walked.

    Walks the furthest reach of each diagonal, one edit after the other, so near texts cost little more than their length;
    those with many edits are then taken row by row.
    """
    n = min(len(a), len(b))
    if abs(len(a) - len(b)) > most:
        return None
    differ = np.flatnonzero(a[:n] != b[:n])
    lead = int(differ[0]) if len(differ) else n
    a, b = a[lead:], b[lead:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) if max(n, m) <= most else None
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca, cb = np.bincount(inverse[:n], minlength=len(ids)), np.bincount(inverse[n:], minlength=len(ids))
    if max(np.maximum(ca - cb, 0).sum(), np.maximum(cb - ca, 0).sum()) > most:
        return None
    a, b = inverse[:n].astype(np.int64), inverse[n:].astype(np.int64)
    if n > 1 and m > 1:  # an edit changes two pairs of neighbours on either side at most
        _, twos = np.unique(np.concatenate([a[:-1] * len(ids) + a[1:], b[:-1] * len(ids) + b[1:]]), return_inverse=True)
        ca, cb = np.bincount(twos[: n - 1], minlength=n + m), np.bincount(twos[n - 1 :], minlength=n + m)
        if max(np.maximum(ca - cb, 0).sum(), np.maximum(cb - ca, 0).sum()) > 2 * most:
            return None
    la, lb = a.tolist(), b.tolist()
    goal, reach = m - n, {0: -1}
    for d in range(min(most, _FEW) + 1):
        now = {}
        for k in range(-min(d, n), min(d, m) + 1):
            i = 0 if d == 0 else max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            i = min(i, n, m - k)
            if i < max(0, -k):
                continue
            while i < n and i + k < m and la[i] == lb[i + k]:
                i += 1
            now[k] = i
        if now.get(goal, -1) >= n:
            return d
        reach = now
    if most <= _FEW:
        return None
    return _rows(la, lb, most) if n <= _BITS else _wide(a, b, most, _FEW, reach)


def _rows(a: list[int], b: list[int], most: int) -> int | None:
    """The distance by rows whose differences are bits of two whole numbers; stops where the last row has left the band."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    n, left = len(a), len(b)
    full, last, up, down, d = (1 << n) - 1, 1 << (n - 1), (1 << n) - 1, 0, n
    for x in b:
        same = at.get(x, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | (~(across | up) & full), up & across
        d += 1 if more & last else -1 if less & last else 0
        left -= 1
        if d - left > most:
            return None
        more, same = more << 1 | 1, same | down
        up, down = (less << 1 | ~(same | more)) & full, more & same
    return d if d <= most else None


def _wide(a: np.ndarray, b: np.ndarray, most: int, d: int, known: dict[int, int]) -> int | None:
    """The walk again with all diagonals of a step in one array, for texts too long for _rows()."""
    n, m = len(a), len(b)
    low, high = -min(most, n), min(most, m)
    k = np.arange(low, high + 1)
    v = np.full(len(k) + 2, -(1 << 40), dtype=np.int64)
    for x, i in known.items():
        v[x - low + 1] = i
    limit = np.minimum(n, m - k)
    a, b = np.append(a, -1), np.append(b, -2)
    while d < most:
        d += 1
        i = np.minimum(np.maximum(np.maximum(v[1:-1] + 1, v[:-2]), v[2:] + 1), limit)
        i[i < np.maximum(0, -k)] = -(1 << 40)
        live = np.flatnonzero((i >= 0) & (i < limit))
        while len(live):
            live = live[a[i[live]] == b[i[live] + k[live]]]
            i[live] += 1
            live = live[i[live] < limit[live]]
        v[1:-1] = i
        if i[(m - n) - low] >= n:
            return d
    return None


def _classes(docs: DataFrame, functions: int, least: int) -> DataFrame:
    """key, id, n (words), sketch: one row per text. docs: key, id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, out = [], []
            for t in b.column("text").to_pylist():
                h = word_hashes(t)
                n.append(len(h))
                out.append(text_sketches(h, functions, least))
            ends = np.r_[0, np.cumsum([len(x) for x in out])]
            flat = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), pa.array(n, pa.int64()), lists], names=["key", "id", "n", "sketch"])

    kind = docs.schema["id"].dataType.simpleString()
    rows = map_arrow(docs, run, f"key binary, id {kind}, n bigint, sketch array<bigint>")
    return rows.groupBy("key").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))


def _shared(band: DataFrame, similarity: float) -> DataFrame:
    """Those of the rows (key, n, s, c) whose s some other row has too, with head: an earlier text of the bucket that can be near, or null.

    Rows are sorted by s and key. A task holds one batch, one row and the first text of each length class of the present s; that is the head of
    the class and of the one before, whose texts it may be near to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the last row so far, and whether the one before had its s
        met, now, heads = False, None, {}

        def headed(b: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal now, heads
            out = []
            for key, n, s, c in zip(*(b.column(x).to_pylist() for x in ("key", "n", "s", "c")), strict=True):
                if s != now:
                    now, heads = s, {}
                found = next((heads[k] for k in (c, c - 1, c + 1) if k in heads and min(n, heads[k][1]) >= similarity * max(n, heads[k][1])), None)
                out.append(found and found[0])
                heads.setdefault(c, (key, n))
            return pa.RecordBatch.from_arrays([*(b.column(x) for x in ("key", "n", "s", "c")), pa.array(out, pa.binary())], names=["key", "n", "s", "c", "head"])

        for b in batches:
            if not b.num_rows:
                continue
            s = b.column("s").to_numpy(zero_copy_only=False)
            pair = s[1:] == s[:-1]
            ok = np.r_[False, pair] | np.r_[pair, False]
            if last is not None:
                same = last.column("s")[0].as_py() == int(s[0])
                ok[0] |= same
                if met or same:
                    yield headed(last)
            yield headed(b.slice(0, b.num_rows - 1).filter(pa.array(ok[:-1])))
            last, met = b.slice(b.num_rows - 1), bool(ok[-1])
        if last is not None and met:
            yield headed(last)

    return map_arrow(band.repartition("s").sortWithinPartitions("s", "key"), run, "key binary, n bigint, s bigint, c int, head binary")


def word_bag(hashes: np.ndarray) -> np.ndarray:
    """Which cells the words fall in, each with its occurrence number, as packed bits."""
    h = labelled_kmers(hashes, 1)
    bits = np.zeros(min(1 << max(6, (8 * len(h) - 1).bit_length()), _CELLS), dtype=bool)
    bits[(h >> np.uint64(20)) & np.uint64(len(bits) - 1)] = True
    return np.packbits(bits)


def same_cells(bags: list[bytes]) -> np.ndarray:
    """The bags as rows of bytes with as many cells as the smallest has: the halves of a larger one are laid upon each other."""
    size = min(map(len, bags))
    return np.array([np.bitwise_or.reduce(np.frombuffer(x, dtype=np.uint8).reshape(-1, size), axis=0) for x in bags])


def common_cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many cells each row of a and each row of b have in common, some thousand cells at a time."""
    bits = lambda x: np.unpackbits(x, axis=1).astype(np.float32)
    return sum(bits(a[:, k : k + 512]) @ bits(b[:, k : k + 512]).T for k in range(0, a.shape[1], 512))


def _bags(texts: DataFrame) -> DataFrame:
    """key, text, bag of each of the texts (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [word_bag(word_hashes(t)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("text"), pa.array(bags, pa.binary())], names=["key", "text", "bag"])

    return map_arrow(texts.select("key", "text"), run, "key binary, text string, bag binary")


def possible_pairs(n: np.ndarray, bags: list[bytes], groups: np.ndarray, home: np.ndarray, side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j (i < j), apart: pairs that can be similar: of other groups, not both away from home, of near lengths and with near bags.

    side: 0 or 1; where both occur only pairs of different sides are given. An edit changes at most one word on
    each side, so neither text can fill more cells that the other leaves empty than there are edits.
    """
    two = len(np.unique(side)) > 1
    x, y = (np.flatnonzero(side == np.min(side)), np.flatnonzero(side != np.min(side))) if two else (np.arange(len(n)),) * 2
    near = groups[x, None] != groups[None, y]
    near &= home[x, None] | home[None, y]
    most = ((1 - similarity) * np.maximum(n[x, None], n[None, y]) + 1e-9).astype(np.int32)
    near &= np.abs(n[x, None] - n[None, y]) <= most
    if not two:
        near = np.triu(near, 1)
    if not near.any():
        return (np.zeros(0, dtype=np.int64),) * 3
    cells = same_cells(bags)
    full = np.array([np.unpackbits(row).sum() for row in cells], dtype=np.float32)
    apart = (np.maximum(full[x, None], full[None, y]) - common_cells(cells[x], cells[y]) + 0.5).astype(np.int32)
    i, j = np.nonzero(near & (apart <= most))
    return np.minimum(x[i], y[j]), np.maximum(x[i], y[j]), apart[i, j]


def nearest_pairs(i: np.ndarray, j: np.ndarray, apart: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs that are the nearest of their two groups, one for each two."""
    x, y = np.minimum(groups[i], groups[j]), np.maximum(groups[i], groups[j])
    order = np.lexsort((apart, y, x))
    first = order[np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)]] if len(order) else order
    return i[first], j[first], apart[first]


def _mixed(m: DataFrame) -> DataFrame:
    """Those of the members (key, n, s, c, home, r) whose bucket holds more than one group, with whether they are of the bucket's greatest group (big) and into
    how many blocks the others and how many lots that one are dealt; a bucket of one block has no such group. Of buckets with the same members one is kept."""
    held = [F.sum(F.xxhash64(F.lit(k), "key").cast("decimal(38,0)")).alias(f"h{k}") for k in (0, 1)]  # tells buckets of other members apart
    group = m.groupBy("s", "c", "r").agg(F.count("*").alias("n"), F.max("home").alias("any"), *held)
    size = group.groupBy("s", "c").agg(
        F.sum("n").alias("all"), F.max(F.struct("n", "r")).alias("top"), F.max("any").alias("any"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1")
    )
    size = size.where((F.col("all") > F.col("top.n")) & F.col("any"))
    blocks = lambda n: F.ceil(n / _BLOCK).cast("int")
    few = F.col("all") <= _BLOCK  # these all meet in one row
    dealt = (
        F.when(few, 1).otherwise(blocks(F.col("all") - F.col("top.n"))).alias("blocks"),
        F.when(few, 0).otherwise(blocks(F.col("top.n"))).alias("lots"),
        F.col("top.r").alias("top"),
    )
    size = size.groupBy("c", "all", "h0", "h1").agg(F.min(F.struct("s", *dealt)).alias("x")).select("c", "x.*")
    return m.join(size, ["s", "c"]).withColumn("big", (F.col("r") == F.col("top")) & (F.col("lots") > 0)).drop("top")


def met_before(s: int, owners: np.ndarray, sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs i, j have a sketch below s in common. sketches: those of all members, each beside its owner."""
    used = np.zeros(int(max(i.max(), j.max())) + 1 if len(i) else 0, dtype=bool)
    used[i] = used[j] = True
    at = np.cumsum(used) - 1
    low = (sketches < s) & (owners < len(used))
    low[low] = used[owners[low]]
    _, column, size = np.unique(sketches[low], return_inverse=True, return_counts=True)
    often = size[column] > 1
    row, column = at[owners[low][often]], (np.cumsum(size > 1) - 1)[column[often]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    met = np.zeros(len(i), dtype=bool)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, 512):
        a, b = np.searchsorted(column, (k, k + 512))
        has = np.zeros((int(used.sum()), 512), dtype=np.float32)
        has[row[a:b], column[a:b] - k] = 1
        met |= (has @ has.T)[at[i], at[j]] > 0
    return met


def parts_of(n: np.ndarray, texts: int, words: int) -> np.ndarray:
    """The part of each of some texts of n words, in turn: so many texts or words make one, and a longer text is one alone or the last of one."""
    cost = np.maximum(n / words, 1 / texts)
    return np.floor(np.cumsum(cost) - cost + 1e-9).astype(np.int64)


class _Members:
    """The members of a bucket that meet in one row, as arrays."""

    def __init__(self, m: pa.ListScalar):
        v = self.rows = m.values
        get = lambda c: v.field(v.type.get_field_index(c))
        self.keys, roots = get("key").to_pylist(), get("r").to_pylist()
        number = {r: k for k, r in enumerate(sorted(set(roots)))}
        self.groups = np.array([number[r] for r in roots], dtype=np.int64)
        self.n, self.home, self.side = (get(c).to_numpy(zero_copy_only=False) for c in ("n", "home", "side"))
        self.get = get

    def pairs(self, s: int, bags: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """i, j, apart of the possible pairs of other groups that meet in no bucket before s."""
        i, j, apart = possible_pairs(self.n, bags, self.groups, self.home, self.side, similarity)
        if len(i):
            lists = self.get("met")
            owners = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            here = ~met_before(s, owners, lists.flatten().to_numpy(zero_copy_only=False), i, j)
            i, j, apart = i[here], j[here], apart[here]
        return i, j, apart


_TILE = ("s", "c", "i", "j", "p", "q")


def _partnered(members: DataFrame, similarity: float) -> DataFrame:
    """Members of a bucket that have a possible partner of another group in it and in no bucket before, once in each tile where they meet.
    members: s, c, home, key, n, r, met (the sketches of its buckets of class c), bag, blocks, lots, big.

    Most members of a bucket are often connected already. These (the greatest group) only meet the others, which meet each
    other too. The others are dealt into blocks by hash; two blocks or one and a lot of the greatest group meet in one row.
    """
    by, sizes = ["s", "c"], (_PART, _PART_WORDS)
    deal = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    d = members.withColumn("own", F.when(F.col("big"), F.col("blocks") + deal(F.greatest("lots", F.lit(1)))).otherwise(deal(F.col("blocks"))))
    # each row of a small block meets all small blocks and all lots, each row of a lot the small blocks
    last = F.col("blocks") + F.when(F.col("big"), 0).otherwise(F.col("lots")) - 1
    d = d.select("*", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    d = d.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).withColumn("side", F.col("own") == F.col("j"))
    fields = ("key", "r", "n", "home", "side", "met", "bag")
    d = d.groupBy(*by, "i", "j").agg(F.collect_list(F.struct(*fields)).alias("m")).where(F.size("m") > 1)
    out = "s bigint, c int, i int, j int, p int, q int, side boolean, key binary, r binary, n bigint, home boolean, met array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, *tile in zip(batch.column("m"), *(batch.column(x).to_pylist() for x in ("s", "c", "i", "j")), strict=True):
                v = _Members(m)
                i, j, _ = v.pairs(tile[0], v.get("bag").to_pylist(), similarity)
                if not len(i):
                    continue
                part, first = np.zeros(len(v.n), dtype=np.int64), 0
                going = np.unique(np.r_[i, j])
                for side in np.unique(v.side):
                    own = going[v.side[going] == side]
                    part[own] = first + parts_of(v.n[own], *sizes)
                    first = part[own].max(initial=first - 1) + 1
                p, q = np.minimum(part[i], part[j]), np.maximum(part[i], part[j])
                code = np.unique(np.concatenate([(p * first + q) * len(v.n) + x for x in (i, j)]))
                at, pq = code % len(v.n), code // len(v.n)
                same = [pa.array(np.full(len(at), x), t) for x, t in zip(tile, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
                parts = [pa.array(x, pa.int32()) for x in (pq // first, pq % first)]
                rows = [v.get(x).take(pa.array(at)) for x in ("key", "r", "n", "home", "met")]
                yield pa.RecordBatch.from_arrays([*same, *parts, pa.array(part[at] == pq % first), *rows], names=[*_TILE, "side", "key", "r", "n", "home", "met"])

    return map_arrow(d, run, out)


def tile_links(groups: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], near: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Links that join all groups that near pairs join, one fewer than these; of each two groups the nearest pair is compared first, then all that are still apart."""
    above, tried, out = {}, set(), []

    def root(g: int) -> int:
        while g in above:
            above[g] = g = above.get(above[g], above[g])
        return g

    for i, j, apart in (nearest_pairs(*pairs, groups), pairs):
        order = np.argsort(apart, kind="stable")
        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            a, b = root(int(groups[x])), root(int(groups[y]))
            if a != b and (x, y) not in tried:
                tried.add((x, y))
                if near(x, y):
                    above[a] = b
                    out.append((x, y))
    return out


def _tile_links(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a, b: links of the members (those of _partnered()) of each tile; texts: key, text. A task holds the texts of one tile and one Arrow batch."""
    d = members.join(texts.select("key", "text").hint("merge"), "key")
    d = d.groupBy(*_TILE).agg(F.collect_list(F.struct("key", "r", "n", "home", "side", "met", "text")).alias("m")).select("s", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s, m in zip(batch.column("s").to_pylist(), batch.column("m"), strict=True):
                v = _Members(m)
                h = [word_hashes(t) for t in v.get("text").to_pylist()]
                near = lambda x, y: edit_distance(h[x], h[y], int((1 - similarity) * max(len(h[x]), len(h[y])) + 1e-9)) is not None  # noqa: B023, E731
                pairs = v.pairs(s, [word_bag(x).tobytes() for x in h], similarity)
                rows += [(v.keys[x], v.keys[y]) for x, y in tile_links(v.groups, pairs, near)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return map_arrow(d, run, "a binary, b binary")


def _linked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b[, tb: b's text]) whose texts align; each pair's texts are in one row, so memory is that of two texts.

    Many pairs may have one text in common, the head of a large group. They are dealt into lots and the text goes to each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            ok = []
            for a, ta, tb in zip(batch.column("a"), batch.column("ta"), batch.column("tb"), strict=True):
                if a != last[0]:
                    last = (a, word_hashes(ta.as_py()))
                x, y = last[1], word_hashes(tb.as_py())
                ok.append(edit_distance(x, y, int((1 - similarity) * max(len(x), len(y)) + 1e-9)) is not None)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def with_text(p: DataFrame, x: str, other: str) -> DataFrame:
        hubs = pairs.groupBy(x).agg(F.ceil(F.count("*") / _LOT).cast("int").alias("lots")).where("lots > 1")
        own = texts.select(F.col("key").alias(x), F.col("text").alias(f"t{x}")).join(hubs, x, "left")
        own = own.withColumn("lot", F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1))).drop("lots")
        p = p.join(hubs, x, "left").withColumn("lot", F.pmod(F.xxhash64(other), F.coalesce("lots", F.lit(1))).cast("int")).drop("lots")
        # dealt by lot at any size, as a broadcast of few pairs would leave them where their texts happen to lie
        return p.join(own.hint("merge"), [x, "lot"]).drop("lot")

    met = pairs if "tb" in pairs.columns else with_text(pairs.select("a", "b"), "b", "a")
    return map_arrow(with_text(met, "a", "b").select("a", "b", "ta", "tb"), run, "a binary, b binary")


def components(links: DataFrame, known: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """node, root: the least node of each connected component; links: a, b. known: roots of an earlier call;
    keep: writes a table, which ends the lineage of each round."""
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    if known is not None:
        old = known.where("node <> root")
        both = both.union(old.select("node", "root")).union(old.select("root", "node")).distinct()
    both = keep(both)
    label = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node")
    label = keep(label)
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("next"))
        up = label.select(F.col("node").alias("next"), F.col("root").alias("above"))
        step = step.join(up, "next", "left").select("node", "root", F.coalesce("above", "next").alias("next"))
        step = keep(step)
        label = step.select("node", F.col("next").alias("root"))
        if step.where("root <> next").isEmpty():
            return label


def near_duplicate_classes(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    similarity: float = 0.8,
    functions: int = 6,
    least: int = 5,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """key, id, n, root, class_id per distinct text: root is the key of its group, class_id the group's least id.

    key is the MD5 of the text; a null text is an empty one. Texts without words are near nothing but their own
    copies. Of equal ids the texts still count one by one, and a null id is never the least unless a group has no other.
    Extra columns play no part, and an empty table gives no rows. Texts count whole; an alignment takes time in proportion to its edits
    times its band, so two texts of a million words with a tenth of them changed take minutes in one task.
    earlier (text, before): other texts that documents with this text once had, before lines were cut from them. A
    text and what it was before are in one group.
    """
    d, same = _keyed(docs, text, doc_id), None
    with Scratch(docs.sparkSession) as scratch:
        if earlier is not None:
            old = earlier.select(_key_of(F.col("text")).alias("a"), _key_of(F.col("before")).alias("b"), _text_of(F.col("before")).alias("t"))
            old = scratch.keep(old.where("a <> b").groupBy("a", "b").agg(F.min("t").alias("t")))
            same = old.select("a", "b")
            before = old.select(F.col("b").alias("key"), F.lit(None).cast(d.schema["id"].dataType).alias("id"), F.col("t").alias("text"))
            d = d.withColumn("now", F.lit(True)).unionByName(before.withColumn("now", F.lit(False)))
        out = _grouped(d, similarity, functions, least, scratch, same)
        if same is not None:
            out = out.join(d.where("now").select("key").distinct(), "key", "left_semi")
        out = stored(out)
    return out.join(out.groupBy("root").agg(F.min("id").alias("class_id")), "root").select("key", "id", "n", "root", "class_id")


def _grouped(d: DataFrame, similarity: float, functions: int, least: int, scratch: Scratch, same: DataFrame | None) -> DataFrame:
    """key, id, n, root of each distinct text of d (key, id, text). same: links (a, b) that are known."""
    keep, narrow = scratch.keep, scratch.keep_narrow
    classes = keep(_classes(d.select("key", "id", "text"), functions, least))
    own = F.floor(F.log("n") / -math.log(max(similarity, 1e-9) * 0.999)).cast("int")
    rows = classes.where("n > 0").select("key", "n", own.alias("c"), F.explode("sketch").alias("s"))
    band = keep(_shared(rows, similarity))
    tried = narrow(band.where("head is not null").groupBy("key").agg(F.min("head").alias("a")).select("a", F.col("key").alias("b")))
    # buckets by length: a text is in its own class (at home) and in the next, so that any two of near lengths meet
    spots = F.explode(F.array(*[F.struct((F.col("c") + k).alias("c"), F.lit(k == 0).alias("home")) for k in (0, 1)]))
    # a text is shuffled once to learn all of this, whatever the size of the tables it meets
    heads = tried.select(F.col("a").alias("key"), F.lit(True).alias("is_head")).distinct()
    texts = d.select("key", "text").join(narrow(band.select("key").distinct()).hint("merge"), "key", "left_semi")
    texts = texts.groupBy("key").agg(F.min("text").alias("text")).join(tried.withColumnRenamed("b", "key").hint("merge"), "key", "left")
    texts = keep(texts.join(heads.hint("merge"), "key", "left"))
    links = _linked(texts.where("a is not null").select("a", F.col("key").alias("b"), F.col("text").alias("tb")), texts.where("is_head"), similarity)
    roots = components(links if same is None else links.unionByName(same), keep=narrow)

    root = roots.select(F.col("node").alias("key"), F.col("root").alias("r"))
    m = band.select("key", "n", "s", "c").join(root, "key", "left").withColumn("r", F.coalesce("r", "key"))
    apart = m.groupBy("s").agg(F.min("r").alias("r1"), F.max("r").alias("r2")).where("r1 <> r2").select("s")
    left = keep(_mixed(m.join(apart, "s").select("key", "n", "s", "r", spots.alias("x")).select("key", "n", "s", "r", "x.*")))
    if not left.isEmpty():
        near = keep(_bags(texts.join(left.select("key").distinct().hint("merge"), "key", "left_semi")))
        own = left.groupBy("key").agg(F.collect_list(F.struct(*[c for c in left.columns if c != "key"])).alias("all"))
        met = F.transform(F.filter("all", lambda x: x["c"] == F.col("x.c")), lambda x: x["s"]).alias("met")
        members = own.join(near.select("key", "bag"), "key").select("*", F.explode("all").alias("x")).select("key", "bag", met, "x.*")
        roots = components(_tile_links(keep(_partnered(members, similarity)), near, similarity), roots, narrow)
    out = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    return out.select("key", "id", "n", "root")


def _text_of(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _key_of(text: Column) -> Column:
    return F.unhex(F.md5(_text_of(text)))


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(_key_of(col(text)).alias("key"), col(doc_id).alias("id"), _text_of(col(text)).alias("text"))


def label_near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, class_id for every document: documents with one class_id are copies or near copies of each other."""
    classes = near_duplicate_classes(docs, text=text, doc_id=doc_id, **options)
    d = docs.select(_key_of(col(text)).alias("key"), col(doc_id).alias("doc_id"))
    return d.join(classes.select("key", "class_id"), "key").select("doc_id", "class_id")


def without_near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of each group, with its own columns: that with the least id (a null one only if there is no other), of equal rows any one."""
    classes = near_duplicate_classes(docs, text=text, doc_id=doc_id, **options)
    first = F.min_by(F.struct("key", "id"), F.struct(F.col("id").isNull(), "id", "key")).alias("x")
    best = classes.groupBy("root").agg(first).select("x.*")
    d = docs.select(F.struct(*[col(c).alias(c) for c in docs.columns]).alias("row"), _key_of(col(text)).alias("key"), col(doc_id).alias("id"))
    mine = d.join(best.select(F.col("key").alias("k"), F.col("id").alias("i")), (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")))
    copies = mine.groupBy("key", "id").agg(F.first("row").alias("row"))
    return copies.select("row.*")
