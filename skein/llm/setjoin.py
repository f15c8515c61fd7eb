"""All similar pairs between set-valued records (problem 4): T-occurrence list merging.

A record is a query of its items; a partner must occur in at least T of their
inverted lists. The T - 2 longest lists (the most frequent items) are never merged:
a partner then occurs at least twice in the rest, the short lists of the record's
rarest items, so those are merged for ids that occur twice. The lists are
partitioned by item and every record is sent to the partitions of its short lists. Instead
of a heap that skips to the next id present in enough lists, the merge jumps
straight to ids present in two: the short lists are kept by pairs of items, in order
of record size, so a lookup yields the ids of admissible size in the intersection
of two lists and passes over all others. Ids that survive a parity sketch (a
lower bound of the difference) are looked up in the longest lists by binary search,
and those that reach the required overlap are emitted, by the partition of the first
common item alone.

All bounds are integers of the threshold as a fraction, so a similarity exactly at
the threshold counts and nothing is lost. Records of equal sets are one class:
the smallest id takes part and classes expand at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.runtime import BROADCAST_ROWS, materialize, small_or_none, width

#: The most frequent items, ranked by frequency (16 bytes each, broadcast); all others are rarer and come before them by value.
RANKED = 1_000_000
#: Largest rank coded by gaps of a byte.
GAPS = 20_000
#: Records of an item's short list beyond which the list is cut into groups.
LIST = 1_000_000
#: Items of all records sent to one partition, at most about.
PART = 6_000_000
#: Size of a record beyond which it looks up by single items: the pairs of a prefix grow as its square.
LONG = 200
#: Candidates compared at once.
STEP = 250_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (splitmix64)."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _gaps(flat: np.ndarray, lens: np.ndarray) -> bytes:
    """Ascending runs as bytes: a gap g is g // 255 bytes of 255 and one of g % 255."""
    first = np.cumsum(lens) - lens
    gap = np.diff(flat, prepend=0)
    gap[first[lens > 0]] = flat[first[lens > 0]]
    out = np.full(int((gap // 255 + 1).sum()), 255, np.uint8)
    out[np.cumsum(gap // 255 + 1) - 1] = gap % 255
    return out.tobytes()


def _ungaps(data: bytes, lens: np.ndarray) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    cum = np.cumsum(b, dtype=np.int64)[b != 255]
    ends = np.cumsum(lens)
    base = np.concatenate([[0], cum[ends[:-1] - 1]]) if len(lens) else cum
    return (cum - np.repeat(base, lens)).astype(np.int32)


class Bounds:
    """Integer bounds of a Jaccard threshold num / den."""

    def __init__(self, threshold: float | str) -> None:
        f = Fraction(str(threshold))
        self.num, self.den = f.numerator, f.denominator

    def least(self, size):
        """Overlap with any partner of at most this size; also the least size of a partner."""
        return -(-self.num * size // self.den)

    def least_longer(self, size):
        """Overlap with any partner of at least this size."""
        return -(-2 * self.num * size // (self.num + self.den))

    def overlap(self, both):
        """Overlap of two records of sizes adding up to `both`."""
        return -(-self.num * both // (self.num + self.den))

    def difference(self, both):
        """Largest symmetric difference of two records of sizes adding up to at most `both`."""
        return both * (self.den - self.num) // (self.num + self.den)


def merge_lists(ids: np.ndarray, lens: np.ndarray, flat: np.ndarray, mine, bounds: Bounds, depth: int, probe: np.ndarray | None = None, index: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (id, id, size, size, overlap) whose first common item is `mine` (a function of ranks -> mask).

    flat: the records' ranks, ascending within each record. probe and index: masks of
    the records that look up or are looked up; all by default.
    """
    order = np.lexsort((ids, lens))  # records by size: a lookup's partners are shorter, or equal with a smaller place
    starts = (np.cumsum(lens) - lens)[order]
    lens, ids = lens[order], ids[order]
    flat = flat[_runs(starts, lens)]
    probe = np.ones(len(ids), bool) if probe is None else probe[order]
    index = np.ones(len(ids), bool) if index is None else index[order]
    first = np.cumsum(lens) - lens
    n = len(ids)
    if len(flat) and int(flat.min()) >= 0 and int(flat.max()) < 1 << 24:
        seen = np.zeros(int(flat.max()) + 1, bool)
        seen[flat] = True
        dic = np.flatnonzero(seen)
        tok = (np.cumsum(seen, dtype=np.int32) - np.int32(1))[flat]  # keeps the order of ranks
    else:
        dic = np.unique(flat)
        tok = np.searchsorted(dic, flat).astype(np.int32)
    del flat
    d = len(dic)
    own = mine(dic)
    # two parity sketches: bit b is the parity of the number of items hashed to b
    sketch = [_parities(tok, lens, np.uint64(1) << (_mix(dic) >> np.uint64(shift) & np.uint64(63))) for shift in (7, 29)]
    small = np.int32 if d * n < 1 << 31 else np.int64
    lists = np.repeat(np.arange(n, dtype=small), lens)
    lists += tok.astype(small) * small(n)
    lists.sort()  # the inverted lists, one after another: for binary search

    def entries(of: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys (item or pair of items), record and place of the last item; `most` first items of a record start a key."""
        keys, recs, places = [], [], []
        for p in range(int(most[of].max(initial=0))):
            r = np.flatnonzero(of & (most > p)).astype(np.int32)
            a = tok[first[r] + p]
            keep = own[a]
            r, a = r[keep], a[keep]
            if depth == 1:
                keys.append(a)
                recs.append(r)
                places.append(np.full(len(r), p, np.int32))
                continue
            for q in range(p + 1, int((most[r] + 1).max(initial=0))):
                s = (q <= most[r]) & (q < lens[r])
                keys.append(a[s].astype(np.int64) * d + tok[first[r[s]] + q])
                recs.append(r[s])
                places.append(np.full(int(s.sum()), q, np.int32))
        if not keys:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(keys).astype(np.int64), np.concatenate(recs), np.concatenate(places)

    ik, ir, ip = entries(index, lens - bounds.least_longer(lens) + 1)
    pk, pr, pp = entries(probe, lens - bounds.least(lens) + 1)
    if not len(ik) or not len(pk):
        return
    if d**depth < (1 << 62) // n:
        code = ik * n + ir  # records are in order of size
        order = np.argsort(code)
        code, ir, ip = code[order], ir[order].astype(np.int32), ip[order].astype(np.int32)
        want = pk * n + pr
        order = np.argsort(want)  # lookups in the order of the lists
        pk, pr, pp, want = pk[order], pr[order], pp[order], want[order]
    else:
        order = np.lexsort((ir, ik))
        ik, ir, ip = ik[order], ir[order].astype(np.int32), ip[order].astype(np.int32)
        uk, at = np.unique(ik, return_inverse=True)
        code = at * n + ir
        k = np.searchsorted(uk, pk)
        hit = np.flatnonzero((k < len(uk)) & (uk[np.minimum(k, len(uk) - 1)] == pk))
        pk, pr, pp, want = pk[hit], pr[hit], pp[hit], k[hit] * n + pr[hit]
    floor = np.searchsorted(lens, bounds.least(lens))  # first record that is long enough, for each record
    lo = np.searchsorted(code, want - pr + floor[pr])
    hi = np.searchsorted(code, want)  # partners come before the record itself
    del code, want
    some = hi > lo
    some = np.flatnonzero(some)
    some = some[np.argsort(pr[some], kind="stable")]  # all lookups of a record together
    pr, pp, lo, hi, head = pr[some], pp[some], lo[some], hi[some], (pk[some] // d if depth == 2 else pk[some])
    count = hi - lo
    ends = np.cumsum(count)
    near = [x[ir] for x in sketch]
    own_sketch = [x[pr] for x in sketch]
    most = np.minimum(bounds.difference(2 * lens[pr]), 255).astype(np.uint8)  # no partner of at most its size differs by more
    def verified(held: list[tuple]) -> tuple[np.ndarray, ...]:
        """The pairs that reach the required overlap and whose first common item this partition holds."""
        code, need, h = (np.concatenate(v) for v in zip(*held, strict=True))
        u, one, back = np.unique(code, return_index=True, return_inverse=True)
        # the same pair comes under several items; the least is the first common one if this partition holds that
        least = np.full(len(u), d)
        np.minimum.at(least, back, h)
        x, y, need = u % n, u // n, need[one]
        l = lens[x]
        pair = np.repeat(np.arange(len(x)), l)
        t = tok[_runs(first[x], l)]
        want = t.astype(small) * small(n) + y[pair].astype(small)
        order = np.argsort(want)
        want = want[order]
        common = np.empty(len(want), bool)
        common[order] = lists[np.minimum(np.searchsorted(lists, want), len(lists) - 1)] == want
        o = np.bincount(pair[common], minlength=len(x))
        lead = np.full(len(x), d)
        np.minimum.at(lead, pair[common], t[common])
        good = (o >= need) & own[np.minimum(lead, d - 1)] & (lead == least)
        return ids[x[good]], ids[y[good]], lens[x[good]], lens[y[good]], o[good]

    begin, size = 0, 0
    held: list[tuple] = []
    while begin < len(pr):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + STEP)))
        c = count[begin:stop]
        e = np.repeat((lo[begin:stop] - (np.cumsum(c) - c)).astype(np.int32), c)
        e += np.arange(len(e), dtype=np.int32)
        diff = np.bitwise_count(np.repeat(own_sketch[0][begin:stop], c) ^ near[0][e])
        ok = np.flatnonzero(diff <= np.repeat(most[begin:stop], c))
        if len(ok):
            at = begin + np.searchsorted(np.cumsum(c), ok, side="right")
            e = e[ok]
            x, y, h, q = ir[e].astype(np.int64), pr[at].astype(np.int64), head[at], pp[at]
            diff = np.maximum(diff[ok], np.bitwise_count(own_sketch[1][at] ^ near[1][e]))
            both = lens[x] + lens[y]
            need = bounds.overlap(both)
            good = (diff <= both - 2 * need) & (depth + np.minimum(lens[y] - q, lens[x] - ip[e]) - 1 >= need)  # and what can follow the last shared item
            x, y, need, h = x[good], y[good], need[good], h[good]
        else:
            x = ok
        if len(x):
            held.append((y * n + x, need, h))
            size += len(x)
        if size > 500_000:
            yield verified(held)
            held, size = [], 0
        begin = stop
    if held:
        yield verified(held)


def _parities(tok: np.ndarray, lens: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """XOR of the items' bits for each record, some records at a time."""
    ends = np.cumsum(lens)
    out = np.zeros(len(lens), np.uint64)
    for s in range(0, len(lens), 50_000):
        e = min(len(lens), s + 50_000)
        low = int(ends[s] - lens[s])
        out[s:e] = np.bitwise_xor.reduceat(bit[tok[low : int(ends[e - 1])]], ends[s:e] - lens[s:e] - low)
    return out


def _runs(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, ... of lens[i] each, one after another."""
    total = int(lens.sum())
    small = np.int32 if total < 1 << 31 and (not len(starts) or int(starts.max()) + int(lens.max()) < 1 << 31) else np.int64
    at = np.repeat((starts - (np.cumsum(lens) - lens)).astype(small), lens)
    at += np.arange(total, dtype=small)
    return at


def clean(ids: pa.Array, lists: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sizes, items) of the records with an id and at least `least` distinct non-null items of at least 0, items ascending."""
    n = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    flat = lists.flatten()
    v = np.asarray(flat.fill_null(-1) if flat.null_count else flat).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    ok = (v >= 0) & np.asarray(ids.is_valid())[row]
    row, v = row[ok], v[ok]
    span = int(v.max(initial=0)) + 1
    if span < (1 << 62) // max(1, len(n)):
        code = np.sort(row * span + v)
        code = code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code
        row, v = code // span, code % span
    else:
        order = np.lexsort((v, row))
        row, v = row[order], v[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (v[1:] != v[:-1])]) if len(v) else np.zeros(0, bool)
        row, v = row[new], v[new]
    size = np.bincount(row, minlength=len(n))
    keep = size >= max(1, least)
    return np.asarray(ids.fill_null(0))[keep], size[keep], v[keep[row]]


def fingerprint(sizes: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set (sums of mixed items, mixed again)."""
    first = np.cumsum(sizes) - sizes
    out = []
    for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
        s = np.add.reduceat(_mix(items.astype(np.uint64) ^ salt), first) if len(first) else np.zeros(0, np.uint64)
        out.append(_mix(s + sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


class Records:
    """Set-valued records, their classes of equal sets and the frequencies of the items."""

    def __init__(self, df: DataFrame, id_col: str, set_col: str, least: int = 1) -> None:
        self.spark = df.sparkSession
        self.size = least
        self.raw = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(set_col).alias("ids"))
        survey = materialize(self._survey(), "survey")
        self.copies = survey.where("kind = 0").select("h1", "h2", F.col("low").alias("rep"))
        self.has_copies = self.copies.limit(1).count() > 0
        self.items = survey.where("kind = 1").select(F.col("h1").alias("item"), "n")
        total = survey.where("kind = 2").agg(F.sum("n").alias("n"), F.min("low").alias("least")).first()
        self.entries, self.least = total["n"] or 0, total["least"] or 1

    def prints(self) -> DataFrame:
        """Rows (h1, h2, id): the fingerprint of every record's set."""
        least = self.size

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, sizes, items = clean(b.column(0), b.column(1), least)
                h1, h2 = fingerprint(sizes, items)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(ids)], names=["h1", "h2", "id"])

        return self.raw.mapInArrow(f, "h1 bigint, h2 bigint, id bigint")

    def _survey(self) -> DataFrame:
        """Classes of several ids (kind 0), records of each item (kind 1), entries and least size (kind 2)."""
        least_size = self.size

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int8)), *(pa.array(c.astype(np.int64)) for c in cols)], names=["kind", "h1", "h2", "low", "high", "n"])

            entries, least, size = 0, np.iinfo(np.int64).max, 0
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            flats: list[np.ndarray] = []
            for b in batches:
                ids, sizes, items = clean(b.column(0), b.column(1), least_size)
                if not len(ids):
                    continue
                h1, h2 = fingerprint(sizes, items)
                yield rows(0, h1, h2, ids, ids, np.ones(len(ids)))
                flats.append(items)
                size += len(items)
                entries, least = entries + len(items), min(least, int(sizes.min()))
                if size > 1_000_000:
                    keys, counts, flats, size = *_tally(keys, counts, flats), [], 0
                if len(keys) > 2 * RANKED:  # too many to rank anyway: let the shuffle add them up
                    yield rows(1, keys, *(np.zeros(len(keys)),) * 3, counts)
                    keys, counts = keys[:0], counts[:0]
            if flats:
                keys, counts = _tally(keys, counts, flats)
            if len(keys):
                yield rows(1, keys, *(np.zeros(len(keys)),) * 3, counts)
            if entries:
                yield rows(2, *(np.array([v]) for v in (0, 0, least, least, entries)))

        rows = self.raw.mapInArrow(f, "kind tinyint, h1 bigint, h2 bigint, low bigint, high bigint, n bigint")
        per = rows.groupBy("kind", "h1", "h2").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        return per.where("kind > 0 OR low < high")

    def members(self) -> DataFrame:
        """Rows (id, rep) of the records whose set another record has too."""
        side = F.broadcast(self.copies) if small_or_none(self.copies) else self.copies
        return self.prints().join(side, ["h1", "h2"]).select("id", "rep").distinct()


def _tally(keys: np.ndarray, counts: np.ndarray, flats: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, c = np.unique(np.concatenate(flats), return_counts=True)
    k, at = np.unique(np.concatenate([keys, u]), return_inverse=True)
    return k, np.bincount(at, np.concatenate([counts, c]), len(k)).astype(np.int64)


def class_pairs(rec: Records, threshold: float | str) -> DataFrame:
    """Rows (a, b, size_a, size_b, overlap), a < b, of all pairs of classes with a Jaccard similarity from `threshold` on."""
    shipped, cells, meet, cut = cells_of(rec, threshold)
    met = shipped.repartitionById(cells, "cell").sortWithinPartitions("cell").mapInArrow(meet, "a bigint, b bigint, size_a bigint, size_b bigint, overlap bigint")
    return met.distinct() if cut else met.dropDuplicates(["a", "b"])


def cells_of(rec: Records, threshold: float | str) -> tuple[DataFrame, int, Callable, bool]:
    """What class_pairs() sends to its cells, their number, the function that merges the lists of a cell, and whether lists were cut."""
    bounds = Bounds(threshold)
    spark = rec.spark
    depth = 2 if bounds.least(rec.least) >= 2 else 1
    every = small_or_none(rec.items, RANKED)
    parts = max(width(spark), rec.entries * 9 // PART, 1)
    groups = {}
    freq = (rec.items if every else rec.items.orderBy(F.desc("n"), "item").limit(RANKED)).toArrow()  # at most RANKED rows
    items, n = freq.column("item").to_numpy(), freq.column("n").to_numpy()
    order = np.lexsort((items, n))
    rank = np.empty(len(items), np.int64)
    rank[order] = np.arange(len(items))
    by = np.argsort(items)
    table = (items[by], rank[by])
    top = len(items) if every else 0  # 0: ranks below 0 occur
    heavy = np.sort(rank[n > LIST])
    #: whether an item without a rank can be in more than LIST records
    any_heavy = not every and int(n.min(initial=0)) > LIST
    known = None
    raw = rec.raw
    if rec.has_copies:  # all but the first of each class stay out
        if small_or_none(rec.copies, BROADCAST_ROWS):
            c = np.array([tuple(r) for r in rec.copies.select("h1", "h2", "rep").collect()], np.int64)  # at most BROADCAST_ROWS
            known = tuple(c[np.lexsort((c[:, 1], c[:, 0]))].T)
        else:
            raw = raw.join(rec.members().where("id <> rep").select("id"), "id", "left_anti")
    send = spark.sparkContext.broadcast((table, known))
    size = rec.size

    def ranks(flat: np.ndarray, table) -> np.ndarray:
        at = np.minimum(np.searchsorted(table[0], flat), max(0, len(table[0]) - 1))
        if every:
            return table[1][at]
        return np.where(table[0][at] == flat, table[1][at], flat + np.iinfo(np.int64).min)  # no two items share a rank

    def place(r: np.ndarray) -> np.ndarray:
        """Cell of a rank: frequent items in turn, others by a hash."""
        return np.where(r < 0, (_mix(r) >> np.uint64(1)).astype(np.int64), r) % parts

    def ordered(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table, known = send.value
        ids, lens, items = clean(b.column(0), b.column(1), size)
        if known is not None and len(ids):
            h1, h2 = fingerprint(lens, items)
            lo, hi = np.searchsorted(known[0], h1, "left"), np.searchsorted(known[0], h1, "right")
            drop = np.zeros(len(ids), bool)
            for r in np.flatnonzero(hi > lo):
                for k in range(lo[r], hi[r]):
                    drop[r] |= known[1][k] == h2[r] and known[2][k] != ids[r]
            items = items[np.repeat(~drop, lens)]
            ids, lens = ids[~drop], lens[~drop]
        r = ranks(items, table)
        row = np.repeat(np.arange(len(lens)), lens)
        r = np.sort(row * top + r) % top if 0 < top < (1 << 62) // max(1, len(lens)) else r[np.lexsort((r, row))]
        return ids, lens, r

    def prefix(lens: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Record and rank of every item that may be the first common one."""
        row = np.repeat(np.arange(len(lens)), lens)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        short = place < np.repeat(lens - bounds.least(lens) + 1, lens)
        return row[short], flat[short]

    if len(heavy) or any_heavy:
        # how many records have the frequent items among their short lists
        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, counts, flats, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
            for b in batches:
                _, lens, flat = ordered(b)
                r = prefix(lens, flat)[1]
                r = r if any_heavy else r[np.isin(r, heavy)]
                flats.append(r)
                held += len(r)
                if held > 1_000_000:
                    keys, counts, flats, held = *_tally(keys, counts, flats), [], 0
                if len(keys) > 2 * RANKED:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["rank", "n"])
                    keys, counts = keys[:0], counts[:0]
            if flats:
                keys, counts = _tally(keys, counts, flats)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["rank", "n"])

        loads = raw.mapInArrow(load, "rank bigint, n bigint").groupBy("rank").agg(F.sum("n").alias("n")).where(F.col("n") > LIST).collect()  # at most entries / LIST rows
        groups = {r["rank"]: -(-r["n"] // LIST) for r in loads}
    heavy_ranks = np.array(sorted(groups), np.int64)
    cells = parts
    where = {}
    for r, g in groups.items():  # cells of a cut list: g * g, numbered behind the others
        where[r] = cells
        cells += g * g

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lens, flat = ordered(b)
            if not len(ids):
                continue
            start = np.cumsum(lens) - lens
            row, rank = prefix(lens, flat)
            light = ~np.isin(rank, heavy_ranks)
            to = np.unique(place(rank[light]) * len(ids) + row[light])
            sent = [(int(c), 3, to[to // len(ids) == c] % len(ids)) for c in np.unique(to // len(ids))]
            for r in np.unique(rank[~light]):
                g, base = groups[int(r)], where[int(r)]
                rows = np.unique(row[rank == r])
                own = (_mix(ids[rows]) >> np.uint64(9)).astype(np.int64) % g
                for k in np.unique(own):
                    m = rows[own == k]
                    for o in range(g):  # looks up in every group, is looked up by every group
                        if o == k:
                            sent.append((base + int(k) * g + int(k), 3, m))
                        else:
                            sent += [(base + int(k) * g + o, 1, m), (base + o * g + int(k), 2, m)]
            out = []
            for cell, role, rows in sent:
                l = lens[rows]
                f = flat[_runs(start[rows], l)]
                data = _gaps(f, l) if 0 < top <= GAPS else f.tobytes()
                out.append((cell, role, ids[rows].tobytes(), l.astype(np.int32).tobytes() if l.max() > 255 else l.astype(np.uint8).tobytes(), int(l.max() > 255), data))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int32(), pa.int8(), pa.binary(), pa.binary(), pa.int8(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["cell", "role", "ids", "lens", "wide", "items"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(cell: int, got: list) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([g[1] for g in got])
            lens = np.concatenate([g[2] for g in got])
            flat = np.concatenate([g[3] for g in got])
            role = np.concatenate([np.full(len(g[1]), g[0], np.int8) for g in got])
            got.clear()
            _, keep = np.unique(ids, return_index=True)  # a redelivered record
            if len(keep) < len(ids):
                flat = flat[_runs((np.cumsum(lens) - lens)[keep], lens[keep])]
                ids, lens, role = ids[keep], lens[keep], role[keep]
            if cell < parts:
                mine = lambda r: (place(r) == cell) & ~np.isin(r, heavy_ranks)
            else:
                one = max((r for r in where if where[r] <= cell), key=lambda r: where[r])
                mine = lambda r: r == one
            asks, asked = (role & 1) > 0, (role & 2) > 0
            long = lens > LONG
            runs = [merge_lists(ids, lens, flat, mine, bounds, depth, asks & ~long, asked & ~long)]
            if long.any():  # with every record that is long enough for a long one
                runs.append(merge_lists(ids, lens, flat, mine, bounds, 1, asks & long, asked & (lens >= bounds.least(LONG + 1))))
            for a, b, la, lb, o in chain(*runs):
                if len(a):
                    swap = a > b
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, b, a)), pa.array(np.where(swap, a, b)), pa.array(np.where(swap, lb, la)), pa.array(np.where(swap, la, lb)), pa.array(o)], names=["a", "b", "size_a", "size_b", "overlap"])

        now, got = None, []
        for batch in batches:
            for cell, role, i, l, wide, data in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if cell != now:
                    if got:
                        yield from flush(now, got)
                    now, got = cell, []
                lens = np.frombuffer(l, np.int32 if wide else np.uint8).astype(np.int64)
                flat = _ungaps(data, lens) if 0 < top <= GAPS else np.frombuffer(data, np.int64)
                got.append((role, np.frombuffer(i, np.int64), lens, flat))
        if got:
            yield from flush(now, got)

    shipped = raw.mapInArrow(ship, "cell int, role tinyint, ids binary, lens binary, wide tinyint, items binary")
    return shipped, cells, meet, bool(groups)


def similar_records(df: DataFrame, id_col: str, set_col: str, threshold: float | str, least: int = 1) -> DataFrame:
    """Rows (a, b), a < b, of all pairs of records with at least `least` items and a Jaccard similarity from
    `threshold` (above 0, at most 1) on, copies expanded.

    A record's items are the distinct non-null values of at least 0. Records with a null
    id, a null, empty or too small set have no pairs. A redelivered record counts
    once; should its copies have different sets, each set takes part under its id.
    """
    rec = Records(df, id_col, set_col, least)
    pairs = class_pairs(rec, threshold).select("a", "b")
    if not rec.has_copies:
        return pairs
    members = materialize(rec.members(), "members")
    side = F.broadcast(members) if small_or_none(members) else members
    wide = pairs.join(side.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a", "left")
    wide = wide.join(side.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b", "left")
    wide = wide.select(F.coalesce("ia", "a").alias("x"), F.coalesce("ib", "b").alias("y")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    within = members.alias("p").join(side.alias("q"), (F.col("p.rep") == F.col("q.rep")) & (F.col("p.id") < F.col("q.id"))).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
    return wide.unionAll(within).distinct()


def linked_classes(df: DataFrame, id_col: str, set_col: str, threshold: float | str, least: int = 1) -> DataFrame:
    """Rows (id, class_id, copies, links): the class of equal sets of every record with at least `least` items,
    the number of its records, and the number of other classes similar to it."""
    rec = Records(df, id_col, set_col, least)
    pairs = materialize(class_pairs(rec, threshold), "pairs")
    links = pairs.select(F.col("a").alias("class_id")).unionAll(pairs.select("b")).groupBy("class_id").agg(F.count("*").alias("links"))
    every = rec.prints().distinct()
    classes = every.groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    return every.join(classes, ["h1", "h2"]).select("id", "class_id", "copies").join(links, "class_id", "left").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
