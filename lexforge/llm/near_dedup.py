"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles (words in lower case, without
punctuation at their ends), each labelled by its number of occurrence, so that all
shingles of a text are distinct and keep their order. The similarity of two texts is
that of their alignment: m / (a + b - m), where a and b are their numbers of shingles
and m is the largest number of equal shingles that can be matched in order. It is at
most the Jaccard similarity of the shingles, and equal to it where nothing changed
places. Two texts are linked if it is 0.8 or more. As labelled shingles are distinct,
m is the longest increasing subsequence of the positions, kept to a band around the
diagonal: a pair further from it than the similarity allows cannot be matched.

1. Texts with the same word sequence are one class at once; one of them, the
   representative, goes on. A group of a third of all rows is folded here, in two
   steps of aggregation.
2. An Order MinHash sketch takes, for each of ``bands`` hash functions, the
   ``picks`` smallest labelled shingles and keeps their text order. Texts at 0.8 share
   a given band with probability of about 0.8 ** picks: with 24 bands of 4 picks
   all bands miss with probability 0.000003. Texts that share a band are a bucket.
3. In a bucket of up to ``small`` texts all pairs are candidates. A larger one is a
   star: each text is compared with the bucket's most central one, that whose band
   values are shared most often. Near copies of one text have nearly the same centre
   in all their buckets, so a star has one row for each text and not for each pair.
4. Candidates are verified by alignment; links make components by label
   propagation in Spark, with a stored table in each round.
5. What the stars leave open is found by an exact filter, over all texts of large
   buckets that hold more than one component. Two linked texts of a and b shingles
   share at least t / (1 + t) * (a + b) of them, t = 0.8. Shingles that no other of
   these texts has count for nothing; the others are put in order of rarity. If two
   texts share that many, they share one of the first ``own - needed + 1`` of each.
   Texts meet on these few rare shingles, separately for every pair of length
   steps (the bound is tight only if the other's length is known), and each text
   outside a group's commonest component is a candidate with those of other
   components. Near copies with too many changes of their own have nothing left to
   meet on. No pair at 0.8 or more among these texts is lost.

Nothing is collected to the driver but counts, and no bucket is gathered in a task. All
joins are merges: Spark sizes exploded and well compressed tables too low, and a
broadcast of them would pass whole through the driver.

Defined results: null text counts as empty; all texts without a word are one class;
a text of fewer than five words has one shingle, all its words; ids may be of any type
that has an order; a null id is a document like any other, and the class of a group is
its smallest id (null if no document has one); different texts may share an id and are
apart unless they are linked; repeated rows get the same class; an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, lookup, materialize, pieces, row_hash
from .shingles import MULT, WordHashes, labelled, mix, plain_word, windows
from .tokens import utf8

K = 5

#: Words that a task keeps the hashes of. Most words of a large corpus are seen once; more of them cost memory and save little.
WORDS_KEPT = 100_000


def text_shingles(data: bytes, hashes: WordHashes, k: int = K) -> np.ndarray:
    return labelled(windows(hashes.of(data), k))


def sketch(grams: np.ndarray, bands: int, picks: int) -> np.ndarray:
    """One 64-bit value per band: the ``picks`` smallest shingles under the band's hash, hashed in text order."""
    take = min(picks, len(grams))
    seeds = np.array([(b * 0x632BE59BD9B4E019 + 0x1F123BB5) & 0xFFFFFFFFFFFFFFFF for b in range(bands)], dtype=np.uint64)
    picked = np.empty((bands, take), dtype=np.uint64)
    step = max(1, 16384 // len(grams))  # bands at once, so that the work stays in the cache
    for lo in range(0, bands, step):
        h = (grams ^ seeds[lo : lo + step, None]) * MULT
        h ^= h >> np.uint64(32)
        at = np.argpartition(h, take - 1, axis=1)[:, :take] if take < len(grams) else np.broadcast_to(np.arange(take), (len(h), take))
        picked[lo : lo + step] = grams[np.sort(at, axis=1)]
    # The band's number is part of its value, so values of different bands do not meet.
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(take):
        out = (out ^ picked[:, k]) * MULT
        out ^= out >> np.uint64(31)
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = 0.8) -> float:
    """Alignment similarity of two shingle sequences, exact where it is at least ``least`` (else 0 or the value in the band)."""
    na, nb = len(a), len(b)
    if na == 0 or nb == 0:
        return float(na == nb)
    if min(na, nb) < least * max(na, nb):
        return 0.0
    oa, ob = np.argsort(a), np.argsort(b)
    at = np.searchsorted(a[oa], b[ob])
    at[at == na] = 0
    hit = a[oa][at] == b[ob]
    pa_, pb = oa[at[hit]], ob[hit]
    # With m matched, at most a - m shingles of one and b - m of the other stand between a pair and the diagonal.
    band = int((1 - least) / (1 + least) * (na + nb)) + 1
    near = np.abs(pa_ - pb) <= band
    pa_, pb = pa_[near], pb[near]
    m = len(pa_)
    if m < least * (na + nb - m):
        return m / (na + nb - m)
    run = pb[np.argsort(pa_)]
    if (run[1:] < run[:-1]).any():
        tails: list[int] = []
        for x in run.tolist():
            i = bisect.bisect_left(tails, x)
            tails[i : i + 1] = [x]
        m = len(tails)
    return m / (na + nb - m)


def raw_digest(column: str) -> Column:
    return F.unhex(F.md5(utf8(column)))


def sketches(docs: DataFrame, bands: int, picks: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, raw binary, words binary, n, bands array): digests of the text and of its word sequence, the number of shingles and the band values."""
    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("utf8"), raw_digest(text_col).alias("raw"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(plain_word, WORDS_KEPT)
        for b in (piece for batch in batches for piece in pieces(batch)):
            digest, n, values = [], [], []
            for text in b.column(1).to_pylist():
                words = hashes.of(text)
                grams = labelled(windows(words, k))
                digest.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
                n.append(len(grams))
                values.append(sketch(grams, bands, picks).view(np.int64) if len(grams) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(digest, pa.binary()), pa.array(n, pa.int32()), flat], ["doc_id", "raw", "words", "n", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(make, f"doc_id {kind}, raw binary, words binary, n int, bands array<long>")


def texts_of(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, text) of the representatives (rep, doc_id, raw), one row each; rows are found by id and text, as ids may be null or shared."""
    rows = docs.select(F.col(id_col).alias("__id"), raw_digest(text_col).alias("__raw"), utf8(text_col).alias("text"))
    found = rows.join(reps.hint("merge"), (rows["__raw"] == reps["raw"]) & rows["__id"].eqNullSafe(reps["doc_id"])).select("rep", "text")
    return found.dropDuplicates(["rep"])


PER_TEXT = 512  # pairs that share one copy of a text


def parts_of_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) with part_a and part_b: the pairs of one text are dealt into parts of about PER_TEXT."""
    out = pairs
    for key, other in (("a", "b"), ("b", "a")):
        # Only texts in many pairs, such as the centre of a star, have a row here.
        many = pairs.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / PER_TEXT).alias("parts")).filter("parts > 1")
        out = lookup(out, many, [key], [other]).withColumn(f"part_{key}", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1)))).drop("parts")
    return out


def with_text(pairs: DataFrame, dealt: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """The pairs, dealt into parts as ``dealt`` says, with text_<key>; each part of a text's pairs has a copy of the text."""
    part = f"part_{key}"
    copies = dealt.groupBy(F.col(key).alias("of"), F.col(part).alias("copy")).agg(F.count(F.lit(1)).alias("pairs"))
    # Texts without a pair stay behind; the first copy is nearly always the only one.
    each = texts.join(copies.hint("merge"), texts["rep"] == copies["of"]).select("of", "copy", F.col("text").alias(f"text_{key}"))
    return pairs.join(each.hint("merge"), (pairs[key] == each["of"]) & (pairs[part] == each["copy"])).drop("of", "copy", part)


def verify(texts: DataFrame, pairs: DataFrame, k: int, least: float) -> DataFrame:
    """The pairs (a, b) of representatives whose texts are linked. Texts go to the pairs one side at a time, a hot one in copies."""
    dealt = materialize(parts_of_pairs(pairs), "dealt-pairs")
    both = with_text(with_text(dealt, dealt, texts, "b"), dealt, texts, "a").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(plain_word, WORDS_KEPT)
        last, shingles = b"", None  # rows of one id on the left come one after another
        for b in (piece for batch in batches for piece in pieces(batch)):
            keep = []
            for ta, tb in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if shingles is None or ta != last:
                    last, shingles = ta, text_shingles(ta, hashes, k)
                keep.append(similarity(shingles, text_shingles(tb, hashes, k), least) >= least)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    return both.mapInArrow(check, "a long, b long").distinct()


def rare_first(texts: DataFrame, k: int) -> DataFrame:
    """(rep, n, alive): number of shingles and those that another text has too, rarest first."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(plain_word, WORDS_KEPT)
        for b in (piece for batch in batches for piece in pieces(batch)):
            for rep, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = text_shingles(text, hashes, k).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), rep)), pa.array(np.full(len(found), len(found), np.int32)), pa.array(found)], ["rep", "n", "gram"])

    rows = materialize(texts.mapInArrow(grams, "rep long, n int, gram long"), "shingles")
    shared = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    met = lookup(rows, shared, ["gram"], ["rep"]).filter("texts is not null")
    return met.groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "gram")))["gram"].alias("alive"))


STEPS = 8  # length steps within a factor of ``least``


def rare_prefixes(ranked: DataFrame, least: float) -> DataFrame:
    """(low, high, gram, rep, n, is_low): the shingles on which a text meets those of another length step.

    low and high are the steps of the two texts, is_low tells which is this one's.
    """
    width = math.log(1 / least) / STEPS

    def step(n: float) -> int:
        return math.floor(math.log(n) / width + 1e-9)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for batch in batches for piece in pieces(batch)):
            low, high, gram, reps, ns, is_low = [], [], [], [], [], []
            for rep, n, alive in zip(*[b.column(c).to_pylist() for c in range(3)], strict=True):
                own = step(n)
                for other in range(step(least * n), step(n / least) + 1):
                    shortest = max(least * n, math.exp(other * width) - 1e-6)
                    needed = math.ceil(least / (1 + least) * (n + shortest) - 1e-6)
                    first = alive[: max(0, len(alive) - needed + 1)]
                    if not first:
                        break  # and longer texts need more
                    gram += first
                    for out, value in ((low, min(own, other)), (high, max(own, other)), (reps, rep), (ns, n), (is_low, own <= other)):
                        out += [value] * len(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(gram, pa.int64()), pa.array(reps, pa.int64()), pa.array(ns, pa.int32()), pa.array(is_low, pa.bool_())],
                ["low", "high", "gram", "rep", "n", "is_low"],
            )

    return ranked.mapInArrow(emit, "low int, high int, gram long, rep long, n int, is_low boolean")


CELL = 1024


def rare_pairs(prefixes: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b, of texts of different components that meet on a rare shingle."""
    key = ["low", "high", "gram"]
    known = roots.select(F.col("id").alias("rep"), "root")
    rows = materialize(prefixes.join(known.hint("merge"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), "prefixes")
    per_root = rows.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("texts"))
    most = F.max(F.struct("texts", "root"))
    homes = per_root.groupBy(*key).agg(F.count(F.lit(1)).alias("roots"), most["root"].alias("home"), most["texts"].alias("at_home"), F.sum("texts").alias("all")).filter("roots > 1")
    # A frequent shingle's texts meet in cells of at most about CELL by CELL of them.
    homes = homes.select(*key, "home", F.ceil((F.col("all") - F.col("at_home")) / CELL).alias("parts_x"), F.ceil(F.col("all") / CELL).alias("parts_y"))
    mixed = materialize(lookup(rows, homes, key, ["rep"]).filter("home is not null"), "mixed")
    own = lambda parts: F.pmod(F.xxhash64("rep"), F.col(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    left = mixed.filter("root <> home").select(*key, own("parts_x").alias("at_x"), each("parts_y").alias("at_y"), F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("root").alias("root_x"), F.col("is_low").alias("low_x"))
    right = mixed.select(*key, each("parts_x").alias("at_x"), own("parts_y").alias("at_y"), F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("root").alias("root_y"), F.col("is_low").alias("low_y"))
    steps = (F.col("low") == F.col("high")) | (F.col("low_x") != F.col("low_y"))
    met = left.join(right.hint("merge"), [*key, "at_x", "at_y"]).filter((F.col("root_x") != F.col("root_y")) & steps & _close("nx", "ny", least))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _close(a: str, b: str, least: float) -> Column:
    return F.least(a, b) >= least * F.greatest(a, b)


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id of the links (a, b): root is the smallest id of its component.

    Each round gives every id the smallest label around it and then that label's own
    label, so the rounds grow with the logarithm of a component's length.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    # Files and tasks of these tables follow the number of links.
    few = 1 + edges.count() // 200_000
    labels = materialize(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "id").coalesce(few), "labels")
    while True:
        around = edges.join(labels.hint("merge"), edges["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("near"))
        hooked = labels.join(around.hint("merge"), labels["id"] == around["a"]).select("id", F.col("root").alias("old"), F.least("root", "near").alias("near"))
        jump = labels.select(F.col("id").alias("j"), F.col("root").alias("further"))
        stepped = hooked.join(jump.hint("merge"), hooked["near"] == jump["j"], "left").select("id", "old", F.least("near", F.coalesce("further", "near")).alias("root"))
        labels = materialize(stepped.coalesce(few), "labels")
        if labels.filter("old <> root").isEmpty():
            return labels.select("id", "root")


def near_duplicates(
    docs: DataFrame, least: float = 0.8, bands: int = 24, picks: int = 4, k: int = K, small: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class) and class_size (rows)."""
    return _classes(docs, least, bands, picks, k, small, id_col, text_col).select("doc_id", "class_id", "class_size")


def _candidates(members: DataFrame, small: int, least: float) -> DataFrame:
    """(a, b), a < b: all pairs of small buckets and the stars of large ones, from (value, rep, n, size)."""
    few = members.filter(F.col("size") <= small)
    one, two = (few.select("value", F.col("rep").alias(r), F.col("n").alias(n)) for r, n in (("a", "na"), ("b", "nb")))
    pairs = one.join(two.hint("merge"), "value").filter((F.col("a") < F.col("b")) & _close("na", "nb", least)).select("a", "b")
    large = members.filter(F.col("size") > small)
    central = large.groupBy("rep").agg(F.sum("size").alias("score"))
    centres = large.join(central.hint("merge"), "rep").groupBy("value").agg(F.max(F.struct("score", (-F.col("rep")).alias("minus"), F.col("n").alias("nc"))).alias("c"))
    rays = lookup(large.select("value", "rep", "n"), centres.select("value", (-F.col("c.minus")).alias("centre"), "c.nc"), ["value"], ["rep"])
    rays = rays.filter((F.col("rep") != F.col("centre")) & _close("n", "nc", least))
    return pairs.union(rays.select(F.least("rep", "centre"), F.greatest("rep", "centre"))).distinct()


def _classes(docs: DataFrame, least: float, bands: int, picks: int, k: int, small: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: doc_id, raw (digest of its text), root (key of its class), class_id and class_size."""
    thin = materialize(sketches(docs, bands, picks, k, id_col, text_col), "sketches")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "raw"))
    per_run = thin.groupBy("words", F.pmod(F.xxhash64("raw", "doc_id"), F.lit(64)).alias("run")).agg(smallest.alias("first"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("n", "bands")).alias("s"))
    # A representative's key is a number of its own, fixed as the table is stored; ids may be null or shared.
    whole = per_run.groupBy("words").agg(F.min("first").alias("first"), F.sum("rows").alias("rows"), F.min("s").alias("s"))
    reps = materialize(whole.select(F.monotonically_increasing_id().alias("rep"), "words", "first.doc_id", "first.raw", "rows", "s"), "representatives")

    banded = reps.filter("s.n > 0").select("rep", F.col("s.n").alias("n"), F.explode("s.bands").alias("value"))
    sizes = banded.groupBy("value").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = materialize(lookup(banded, sizes, ["value"], ["rep"]).filter("size is not null"), "buckets")
    texts = materialize(texts_of(docs, reps.join(members.select("rep").distinct().hint("merge"), "rep", "left_semi").select("rep", "doc_id", "raw"), id_col, text_col), "texts")
    tried = materialize(_candidates(members, small, least), "pairs")
    roots = components(materialize(verify(texts, tried, k, least), "links"))

    # Texts of large buckets with more than one component: the exact filter takes them all.
    large = members.filter(F.col("size") > small).select("value", "rep").join(roots.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = large.groupBy("value").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1")
    open_ = lookup(large.select("value", "rep"), mixed, ["value"], ["rep"]).filter("r0 is not null").select("rep").distinct()
    ranked = rare_first(texts.join(open_.hint("merge"), "rep", "left_semi"), k)
    more = materialize(rare_pairs(rare_prefixes(ranked, least), roots, least).join(tried.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        # Of the links so far a star of each component is enough.
        stars = roots.filter("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b"))
        roots = components(verify(texts, more, k, least).union(stars))
    root_of = roots.select(F.col("id").alias("rep"), "root")
    groups = reps.join(root_of.hint("merge"), "rep", "left").select("words", "doc_id", F.coalesce("root", "rep").alias("root"), "rows")
    sized = groups.join(groups.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("rows").alias("class_size")).hint("merge"), "root")
    return lookup(thin.select("doc_id", "raw", "words"), sized.select("words", "root", "class_id", "class_size"), ["words"], ["doc_id", "raw"])


def near_dedup(
    docs: DataFrame, least: float = 0.8, bands: int = 24, picks: int = 4, k: int = K, small: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of every class, that with the smallest id, if it has one.

    Of rows equal in id and text the one with the smallest hash of all columns stays.
    """
    classes = _classes(docs, least, bands, picks, k, small, id_col, text_col)
    key, met, nth = fresh(docs, "key", "met", "nth")
    # Ids and digests are shuffled, texts once; of rows that share the smallest id the smallest digest stays.
    stay = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min(F.struct("raw", F.col("doc_id").alias("id"))).alias(met)).select(met)
    # One key for join and window, in which null ids are equal, so that texts are dealt out once; ids and digests are hashed, so texts are sorted once.
    keyed = docs.withColumn(key, F.struct(raw_digest(text_col).alias("raw"), F.col(id_col).alias("id")))
    joined = keyed.join(stay.hint("shuffle_hash"), keyed[key] == stay[met], "left_semi")
    first = F.row_number().over(W.partitionBy(key).orderBy(row_hash(docs)))
    return joined.withColumn(nth, first).filter(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
