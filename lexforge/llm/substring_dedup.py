"""Substring deduplication by recompression.

A window is ``size`` consecutive words of one document; a word goes if it is covered
by a window whose word sequence also starts earlier (smaller id, or same document and
earlier start).

Recompression: a text is a sequence of symbols, at first one per word. In each round
runs of one symbol and then pairs of adjacent symbols (a left one and a right one, by
a bit of the symbol's hash in that round) are replaced by a new symbol. The name of a
new symbol is a hash of what it replaces, so every task names equal runs and pairs
alike: naming is global without a dictionary to ship. Equal substrings therefore get
equal symbols inside, except near their ends. How near is known exactly: for every
boundary between symbols the interval of words is kept on which it depends. A
boundary whose interval lies inside a window is the same in every occurrence of that
window.

1. Of the boundaries of any round whose interval lies inside it, those with a narrow
   interval before the others, every window picks the one with the smallest key. A picked boundary is an anchor, with the hash of its interval as key. Equal
   windows pick the same anchors, so every repeated window has an anchor whose key
   occurs twice; a window without any boundary inside is its own anchor. There are
   about a fifth as many anchors as words.
2. Keys that occur once are dropped. The windows of the remaining anchors are the
   candidates; they are hashed to 96 bits, and for each hash the earliest place
   stays.
3. Words covered by the other places are removed.

Rows are packed: a task sorts its keys into buckets and sends one row of arrays per
bucket. Before sending, a task settles what it can: of a key that occurs several
times in it one place is sent, and of a window several times in it the earliest. A
passage in a third of all documents thus sends one entry per task and flush, not one
per document. The receiving task has its rows sorted by bucket (by Spark, which spills)
and settles one bucket at a time; what it finds is packed by block of documents over several buckets, HELD places at a
time, and a last step makes one row of each document's places, one block at a time.
Memory is that of one bucket or block and of these places. The texts are dealt by id once, and that exchange serves all steps.

Defined results: null text has no words; a text shorter than a window keeps all its
words; rows without an id are documents of their own, before all others, in the order
in which they are read; rows that share an id are versions of one document, and a window
at the same place in two of them is one occurrence; ids that are not whole numbers are
replaced by their rank; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, shuffle_width
from .shingles import WordHashes, mix
from .tokens import utf8

NO_ID = -(2**63)  # rows without an id are numbered from here
IDS = -(2**62)  # and ids begin here
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE2 = np.uint64(0xD1342543DE82EF95)
FLUSH_WORDS = 1_000_000
HELD = 6_000_000  # places that a task holds before it packs them by document
ROUNDS = 3
LONGEST = 10  # words in a symbol
LEAST = 6  # words in an anchor's interval
NARROW = 11  # intervals up to this come first: they serve more windows


class Prefix:
    """Hashes of any ranges of a word sequence from prefix sums, all arithmetic wrapping at 64 bits."""

    def __init__(self, words: np.ndarray, base: np.uint64):
        n = len(words)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * _powers(int(base), n), out=self.sums[1:])
        self.back = _powers(pow(int(base), -1, 2**64), n + 1)  # the base is odd, so it has an inverse

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def layout(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All words with one separator before each document and one at the end, and the places of the separators."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    seps = np.cumsum(np.concatenate([[0], sizes + 1]))
    words = np.zeros(int(seps[-1]) + 1, dtype=np.uint64)
    for d, s in zip(docs, seps[:-1], strict=True):
        words[s + 1 : s + 1 + len(d)] = d
    return words, seps


def anchors(words: np.ndarray, seps: np.ndarray, size: int, prefix: Prefix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, lo, hi): the picked boundaries' keys and intervals, as described above."""
    n = len(words)
    is_sep = np.zeros(n, dtype=bool)
    is_sep[seps] = True
    sym, start, sep = words.copy(), np.arange(n, dtype=np.int64), is_sep.copy()
    lo, hi = start.copy(), start.copy()  # the interval on which a symbol's left boundary depends
    own_lo, own_hi = start.copy(), start + 1  # the interval on which the symbol itself depends
    levels = []
    for r in range(ROUNDS):
        for step in ("run", "pair"):
            m = len(sym)
            if m < 3:
                break
            length = np.diff(start, append=n)
            # Whether the boundary on the left of symbol i goes. Separators never take part.
            free = ~(sep[1:] | sep[:-1])
            if step == "run":
                same = free & (sym[1:] == sym[:-1])
                if same.any():
                    first = np.flatnonzero(np.concatenate([[True], ~same]))
                    times = np.diff(first, append=m)
                    fits = times * length[first] <= LONGEST
                    run = np.repeat(np.arange(len(first)), times)
                    goes = np.concatenate([[False], same & fits[run[1:]]])
                    inside = np.concatenate([[False], same & ~fits[run[1:]]])
                    named = (times > 1) & fits
                    sym[first[named]] = mix(sym[first[named]] + times[named].astype(np.uint64) * BASE2 + np.uint64(1))
                else:
                    goes, inside = np.zeros(m, dtype=bool), None
            else:
                right = (mix(sym + np.uint64((r + 2) * int(BASE) % 2**64)) >> np.uint64(63)).astype(bool)
                goes, inside = np.concatenate([[False], free & ~right[:-1] & right[1:] & (length[:-1] + length[1:] <= LONGEST)]), None
                at = np.flatnonzero(goes)
                sym[at - 1] = mix(sym[at - 1] * BASE2 + mix(sym[at] + np.uint64(r)))
            # That a boundary stays depends on both symbols beside it ...
            lo[1:] = np.minimum(lo[1:], np.minimum(own_lo[:-1], own_lo[1:]))
            hi[1:] = np.maximum(hi[1:], np.maximum(own_hi[:-1], own_hi[1:]))
            if inside is not None:  # ... and, in a run that is too long to be named, on all of the run: outside any window
                lo[inside] = -1
            # ... and a symbol depends on its parts and on the boundaries around them.
            keep = np.flatnonzero(~goes)
            own_lo = np.minimum(own_lo, lo)
            own_lo[:-1] = np.minimum(own_lo[:-1], lo[1:])
            own_hi = np.maximum(own_hi, hi)
            own_hi[:-1] = np.maximum(own_hi[:-1], hi[1:])
            own_lo, own_hi = np.minimum.reduceat(own_lo, keep), np.maximum.reduceat(own_hi, keep)
            sym, start, sep, lo, hi = sym[keep], start[keep], sep[keep], lo[keep].copy(), hi[keep].copy()
        levels.append((lo.copy(), hi.copy()))
    open_ = np.ones(n + 1, dtype=bool)  # windows by start; those that would reach over a separator are never open
    last_ok = np.repeat(seps[1:], np.diff(seps)) - size
    open_[: int(seps[-1])] = np.arange(int(seps[-1])) <= last_ok
    open_[seps] = False
    open_[int(seps[-1]) :] = False
    lo, hi = (np.concatenate([level[k] for level in levels]) for k in (0, 1))
    span = hi - lo
    fit = (span >= LEAST) & (span <= size) & (lo >= 0)
    every_lo, every_hi = lo[fit], hi[fit]
    found = []
    for least, most in ((LEAST, NARROW), (NARROW + 1, size)):
        tier = (every_hi - every_lo >= least) & (every_hi - every_lo <= most)
        lo, hi = every_lo[tier], every_hi[tier]
        first = np.maximum(hi - size, 0)
        passed = np.concatenate([[0], np.cumsum(open_)])
        near = passed[lo + 1] > passed[first]
        lo, hi, first = lo[near], hi[near], first[near]
        if len(lo) == 0:
            continue
        key = prefix.of(lo, hi)
        # Of the boundaries inside it, a window picks the one with the smallest key.
        best = np.full(n + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
        reach = [np.flatnonzero(first + j <= lo) for j in range(size - least + 1)]
        for j, at in enumerate(reach):
            np.minimum.at(best, first[at] + j, key[at])
        used = np.zeros(len(lo), dtype=bool)
        for j, at in enumerate(reach):
            w = first[at] + j
            used[at] |= open_[w] & (best[w] == key[at])
        # Several boundaries may have one interval; that is one anchor.
        _, one = np.unique(lo[used] * 256 + (hi - lo)[used], return_index=True)
        found.append((key[used][one], lo[used][one], hi[used][one]))
        cover = np.zeros(n + 2, dtype=np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, lo + 1, -1)
        open_ &= ~(np.cumsum(cover)[: n + 1] > 0)
    alone = np.flatnonzero(open_)
    found.append((prefix.of(alone, alone + size), alone, alone + size))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _put(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(a.tobytes() for a in arrays), 1)


def _get(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, out, at = zlib.decompress(data), [], 0
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _by(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, places) of each group, places in order."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    cuts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]]) if len(g) else np.zeros(0, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(g[a]), order[a:b]


PACKED = "bucket int, id long, keys binary, places binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["bucket", "id", "keys", "places"]
    )


def _flushes(batches: Iterator[pa.RecordBatch], hashes: WordHashes, extra: int | None = None):
    """Groups of whole documents of about FLUSH_WORDS words: (ids, word arrays, extra values)."""
    ids, docs, more, total = [], [], [], 0
    for b in batches:
        for k, text in enumerate(b.column(1).to_pylist()):
            w = hashes.of(text)
            ids.append(b.column(0)[k].as_py())
            docs.append(w)
            more.append(b.column(extra)[k].as_py() if extra is not None else None)
            total += len(w)
            if total >= FLUSH_WORDS:
                yield np.array(ids, dtype=np.int64), docs, more
                ids, docs, more, total = [], [], [], 0
    if ids:
        yield np.array(ids, dtype=np.int64), docs, more


def _find_anchors(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for ids, docs, _ in _flushes(batches, hashes):
            words, seps = layout(docs)
            key, lo, hi = anchors(words, seps, size, Prefix(words, BASE))
            doc = np.searchsorted(seps, lo, side="right") - 1
            place, span = (lo - seps[doc] - 1).astype(np.uint32), (hi - lo).astype(np.uint8)
            order = np.argsort(key, kind="stable")
            s = key[order]
            new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
            twice = np.zeros(len(s), dtype=bool)
            twice[order] = ~new | np.concatenate([~new[1:], [False]]) if len(s) else False
            sent = np.zeros(len(s), dtype=bool)
            sent[order] = new
            # Known to be shared already: straight to its document. One place of each key is sent.
            rows = []
            for d, at in _by(doc[twice]):
                at = np.flatnonzero(twice)[at]
                rows.append((-1 - int(ids[d]) % buckets, int(ids[d]), None, _put(place[at], span[at])))
            once = np.flatnonzero(sent)
            bucket = (key[once] >> np.uint64(33)) % np.uint64(buckets)
            for b, at in _by(bucket.astype(np.int64)):
                at = np.sort(once[at])
                rows.append((b, None, key[at].tobytes(), _put(ids[doc[at]], place[at], span[at])))
            yield _packed(rows)

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[tuple]]]:
    """Rows sorted by bucket, as (rows to pass on, rows of one bucket): what is known already, then bucket by bucket."""
    rows, now = [], None
    for b in batches:
        passed = []
        for row in zip(*[b.column(c).to_pylist() for c in range(4)], strict=True):
            if row[0] < 0:
                passed.append((row[0], row[1], None, row[3]))
                continue
            if row[0] != now and rows:
                yield [], rows
                rows = []
            now = row[0]
            rows.append(row)
        if passed:
            yield passed, []
    if rows:
        yield [], rows


def _settled(settle, blocks: int, *kinds: str):
    """What is known already passes; what ``settle`` finds in each bucket is packed by block of documents, HELD places at a time.

    A row for each document would be sent by every task; blocks keep these rows few.
    """

    def pack(held: list[tuple]) -> pa.RecordBatch:
        doc, *more = (np.concatenate(c) for c in zip(*held, strict=True))
        return _packed([(-1 - b, None, doc[at].astype("<i8").tobytes(), _put(*(m[at].astype(k) for m, k in zip(more, kinds, strict=True)))) for b, at in _by(doc % blocks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for passed, rows in _buckets(batches):
            if passed:
                yield _packed(passed)
                continue
            held.append(settle(rows))
            total += len(held[-1][0])
            if total >= HELD:
                yield pack(held)
                held, total = [], 0
        if held:
            yield pack(held)

    return run


def _unpacked(*kinds: str):
    """(id, places): one row for each document, from rows sorted by block; one block at a time is in memory."""

    def spread(rows: list[tuple]) -> pa.RecordBatch:
        parts = [_get(p, *kinds) for _, _, p in rows]
        doc = np.concatenate([np.full(len(x[0]), i, np.int64) if k is None else np.frombuffer(k, "<i8") for (i, k, _), x in zip(rows, parts, strict=True)])
        more = [np.concatenate([x[k] for x in parts]) for k in range(len(kinds))]
        found = [(d, _put(*(m[at] for m in more))) for d, at in _by(doc)]
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([p for _, p in found], pa.binary())], ["id", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now = [], None
        for b in batches:
            for block, *row in zip(*[b.column(c).to_pylist() for c in range(4)], strict=True):
                if block != now and rows:
                    yield spread(rows)
                    rows = []
                now = block
                rows.append(row)
        if rows:
            yield spread(rows)

    return run


def _shared(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """(document, place, span) of the anchors of a bucket whose key occurs more than once."""
    parts = [_get(p, "<i8", "<u4", "u1") for _, _, _, p in rows]
    doc, place, span = (np.concatenate([x[k] for x in parts]) for k in range(3))
    key = np.concatenate([np.frombuffer(k, "<u8") for _, _, k, _ in rows])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    shared = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    return doc[shared], place[shared], span[shared]


def _window_keys(prefix: Prefix, prefix2: Prefix, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return prefix.of(at, at + size), (prefix2.of(at, at + size) >> np.uint64(32)).astype(np.uint32)


def _find_windows(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for ids, docs, parts in _flushes(batches, hashes, extra=2):
            words, seps = layout(docs)
            cover = np.zeros(len(words) + 2, dtype=np.int64)
            for d, blobs in enumerate(parts):
                top = len(docs[d]) - size
                for blob in blobs:
                    place, span = _get(blob, "<u4", "u1")
                    place = place.astype(np.int64)
                    first, last = np.maximum(place + span - size, 0), np.minimum(place, top)
                    ok = first <= last
                    np.add.at(cover, first[ok] + seps[d] + 1, 1)
                    np.add.at(cover, last[ok] + seps[d] + 2, -1)
            at = np.flatnonzero(np.cumsum(cover) > 0)
            h1, h2 = _window_keys(Prefix(words, BASE), Prefix(words, BASE2), at, size)
            doc = np.searchsorted(seps, at, side="right") - 1
            place = (at - seps[doc] - 1).astype(np.uint32)
            order = np.lexsort((place, ids[doc], h2, h1))
            a, b = h1[order], h2[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))] if len(a) else order
            later = (ids[doc[order]] != ids[doc[first]]) | (place[order] != place[first])
            rows = []
            gone = np.sort(order[later])
            for d, p in _by(doc[gone]):
                p = gone[p]
                rows.append((-1 - int(ids[d]) % buckets, int(ids[d]), None, _put(place[p], h2[p])))
            sent = np.sort(order[new])
            bucket = (h1[sent] >> np.uint64(33)) % np.uint64(buckets)
            for k, p in _by(bucket.astype(np.int64)):
                p = sent[p]
                rows.append((k, None, h1[p].tobytes() + h2[p].tobytes(), _put(ids[doc[p]], place[p])))
            yield _packed(rows)

    return run


def _later(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """(document, place, hash) of the windows of a bucket that are not the earliest of theirs."""
    parts = [_get(p, "<i8", "<u4") for _, _, _, p in rows]
    doc, place = (np.concatenate([x[k] for x in parts]) for k in range(2))
    sizes = [len(k) // 12 for _, _, k, _ in rows]
    h1 = np.concatenate([np.frombuffer(k, "<u8", n) for (_, _, k, _), n in zip(rows, sizes, strict=True)])
    h2 = np.concatenate([np.frombuffer(k, "<u4", n, 8 * n) for (_, _, k, _), n in zip(rows, sizes, strict=True)])
    order = np.lexsort((place, doc, h2, h1))
    a, b = h1[order], h2[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
    gone = np.sort(order[(doc[order] != doc[first]) | (place[order] != place[first])])
    return doc[gone], place[gone], h2[gone]


def _remove(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for text, blobs, versions in zip(*[b.column(c).to_pylist() for c in (1, 2, 3)], strict=True):
                chunks = text.split()
                kept = chunks
                if blobs:
                    found = [_get(blob, "<u4", "<u4") for blob in blobs]
                    at, tag = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                    at = at.astype(np.int64)
                    if versions is not None:  # places may be those of another version of this id
                        prefix2 = Prefix(hashes.of(text), BASE2)
                        ok = at + size <= len(chunks)
                        at, tag = at[ok], tag[ok]
                        at = at[(prefix2.of(at, at + size) >> np.uint64(32)).astype(np.uint32) == tag]
                    cover = np.zeros(len(chunks) + 1, dtype=np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + size, -1)
                    kept = list(itertools.compress(chunks, (np.cumsum(cover[:-1]) == 0).tolist()))
                n_words.append(len(chunks))
                n_removed.append(len(chunks) - len(kept))
                joined = b" ".join(kept)
                digests.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append(joined.decode("utf-8", "replace") if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())],
                ["id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def ranked_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, rank): distinct ids that are there, numbered in their order from 0. Ranges of ids are counted, then numbered each by itself."""
    ids = docs.select(F.col(id_col).alias("id")).filter("id is not null").distinct().repartitionByRange("id")
    dealt = materialize(ids.withColumn("part", F.spark_partition_id()), "ids")
    # One row a partition.
    before = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(W.partitionBy("part").orderBy("id"))
    return dealt.withColumn("nth", nth).join(F.broadcast(before), "part").select("id", (F.col("base") + F.col("nth") - 1).alias("rank"))


def numbered(key: Column) -> Column:
    """The id as a long; rows without one get numbers of their own below all ids."""
    # Never null by its form too: a filter on nulls before one of the joins would keep Spark from using the texts' exchange again.
    return F.coalesce(key.cast("long"), F.lit(NO_ID) + F.monotonically_increasing_id())


def remove_repeats(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (kept words joined by one space)."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        ranks = ranked_ids(docs, id_col)
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ranks, "id", "left").select(F.col("rank").alias("doc_id"), "text")
        done = remove_repeats(rows, size, with_text=with_text)
        return done.join(ranks, done["doc_id"] == ranks["rank"], "left").select(F.col("id").alias("doc_id"), *done.columns[1:])
    parts = shuffle_width(docs.sparkSession)
    # Packed entries are about a tenth of the texts' size, so a quarter of the partitions holds them.
    few = max(1, parts // 4)
    buckets = 4 * parts
    # The one exchange of the texts; the joins below are on its key.
    dealt = docs.select(numbered(F.col(id_col)).alias("id"), utf8(text_col).alias("utf8")).repartition(parts, "id")
    by_bucket = lambda rows: rows.repartition(few, "bucket").sortWithinPartitions("bucket")
    blobs = lambda found, *kinds: by_bucket(found).mapInArrow(_unpacked(*kinds), "id long, places binary").groupBy("id").agg(F.collect_list("places").alias("blobs"))
    shared = by_bucket(dealt.mapInArrow(_find_anchors(size, buckets), PACKED)).mapInArrow(_settled(_shared, buckets, "<u4", "u1"), PACKED)
    candidates = dealt.join(blobs(shared, "<u4", "u1").hint("shuffle_hash"), "id")
    gone = by_bucket(candidates.mapInArrow(_find_windows(size, buckets), PACKED)).mapInArrow(_settled(_later, buckets, "<u4", "<u4"), PACKED)
    repeated = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("versions")).filter("versions > 1")
    marks = blobs(gone, "<u4", "<u4").join(repeated, "id", "left")
    result = dealt.join(marks.hint("shuffle_hash"), "id", "left").mapInArrow(
        _remove(size, with_text), "id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
    return result.withColumn("doc_id", F.when(F.col("id") >= IDS, F.col("id"))).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")
