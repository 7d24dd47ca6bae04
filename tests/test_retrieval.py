"""Fusion, pruned search, siblings, row ids, deltas, the point table and the ledger against plain versions."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexforge.operators import answer as A
from lexforge.operators import bm25 as B
from lexforge.operators import bm25_index as BI
from lexforge.operators import bm25_search as BS
from lexforge.operators import chunks as C
from lexforge.operators import dense_index as DI
from lexforge.operators import ledger as L
from lexforge.operators import retrieve as R
from lexforge.operators.numbering import numbered
from lexforge.schemas import CHUNK
from lexforge.sources import chunk_files as CF
from lexforge.sources import point_table as PT
from lexforge.sources.stage import stored
from lexforge.streaming.upsert import stream_upserts


def ranked(spark, shift):
    rows = spark.range(40).select((F.col("id") % 4).alias("query_id"), (F.col("id") * 7 % (20 + shift)).alias("row_id"), (-F.col("id")).cast("double").alias("score")).dropDuplicates(["query_id", "row_id"])
    return B.rank_hits(rows)


def test_fused_hits_read_twice(spark):
    """Both sides of a join read the same fused lists; every hit is there once."""
    fused = R.rrf_fuse(ranked(spark, 0), ranked(spark, 3))
    queries = spark.range(4).select(F.col("id").alias("query_id"), F.lit("các hành vi").alias("text"))
    hits = R.top_k_fused(fused, queries, 5, rerank_top_n=30)
    scored = hits.select("query_id", "row_id", (F.col("row_id") % 3).cast("double").alias("new_score"))
    got = R.rerank(hits, scored, queries).collect()
    assert len(got) == len({(r["query_id"], r["row_id"]) for r in got}) == hits.filter("pos <= 25").count()
    pandas = [df.toPandas().set_index(["query_id", "row_id"])["rank"] for df in (ranked(spark, 0), ranked(spark, 3))]
    for r in fused.collect():
        at = (r["query_id"], r["row_id"])
        assert r["score"] == sum(1 / (60 + p[at]) for p in pandas if at in p.index)


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"từ{int(w)}" for w in rng.zipf(1.6, int(rng.integers(0, 40))) if w < 3000)) for i in range(1500)]
    # Rows that answer a question lie together, as those of one document do.
    rows += [(1500 + i, f"xe_máy vượt đèn_đỏ phạt_tiền lần{i} " * (1 + i % 7)) for i in range(100)]
    rows += [(1600 + i, rows[i % 7][1]) for i in range(50)]
    return spark.createDataFrame(rows, "row_id long, page_content string").cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "xe_máy vượt đèn_đỏ phạt_tiền"), (2, "từ1 từ2 từ2 từ7"), (3, "nothing here"), (4, "xe_máy từ1 từ900"), (5, "")], "query_id long, text string")


def test_bm25_blocks(spark, texts, asked):
    for n in (1, 10, 30):
        want = {tuple(r) for r in B.bm25_topk(texts, asked, n).select("query_id", "row_id", "score", "rank").collect()}
        assert {tuple(r) for r in BI.bm25_block_topk(texts, asked, n, block_rows=16).select("query_id", "row_id", "score", "rank").collect()} == want
    posts, stats = stored(B.postings(texts), "p"), B.corpus_stats(texts)
    index = BI.block_index(posts, stats, 16)
    weights = BI.query_weights(asked, B.term_stats(posts, stats))
    bounds = BI.block_bounds(index, weights)
    count = lambda df: {r["query_id"]: r["count"] for r in df.groupBy("query_id").count().collect()}
    every, wanted = count(bounds), count(BI.wanted_blocks(index, weights, bounds, stats, 5))
    # Question 4 has a word in nearly every block, and its best rows in a few.
    assert every[4] > 60 and wanted[4] < every[4] / 2 and set(wanted) == set(every)
    top = BI.block_scores(index, weights, bounds, stats).join(bounds, ["query_id"]).filter(F.floor(F.col("row_id") / 16) == F.col("block"))
    assert top.filter("score > bound").isEmpty()


def vectors_of(spark, n, rng, first=0):
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, 16))
    v[5], v[7] = 0, v[8]
    return v.astype(np.float32), spark.createDataFrame([(first + i, x.tolist()) for i, x in enumerate(v.astype(np.float32))], "id long, embedding array<float>")


def test_pivot_topk(spark):
    rng = np.random.default_rng(2)
    v, rows = vectors_of(spark, 900, rng)
    q, asked = vectors_of(spark, 20, np.random.default_rng(2))
    rows, asked = rows.withColumnRenamed("id", "row_id").union(spark.createDataFrame([(9000, None)], "id long, embedding array<float>")), asked.withColumnRenamed("id", "query_id")
    u, w = DI.unit(v.astype(np.float64)), DI.unit(q.astype(np.float64))
    for options in ({}, {"pivots": 3, "block": 7}, {"most": 500, "block": 50}):
        got = DI.pivot_topk(rows, asked, 10, **options).collect()
        by = {}
        for r in got:
            by.setdefault(r["query_id"], []).append((r["rank"], r["row_id"], r["score"]))
        for k in range(20):
            s = (u * w[k]).sum(axis=1)
            best = np.lexsort((np.arange(900), -s))[:10]
            assert [x[1] for x in sorted(by[k])] == best.tolist() and np.allclose([x[2] for x in sorted(by[k])], s[best], atol=1e-12)
    plan = DI.pivot_scores(rows, asked, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan and "Join" not in plan
    assert DI.pivot_topk(rows.limit(0), asked).count() == 0 and DI.pivot_topk(rows, asked.limit(0)).count() == 0
    assert DI.pivot_topk(rows.filter("row_id = 5"), asked, 3).filter("score = 0").count() == 20


def test_pivots_skip_blocks():
    rng = np.random.default_rng(4)
    pivots = np.eye(8)
    search = DI.Search(np.arange(2), pivots[:2], np.arange(8), pivots, 3)
    seen = {}
    for p in range(8):
        m = DI.unit(pivots[p] + 0.02 * rng.normal(size=(20, 8)))
        angles = np.arccos(m @ pivots[p])
        seen |= {100 * p + i: x for i, x in enumerate(m)}
        search.take(p, angles.min(), angles.max(), (100 * p + np.arange(20)).astype("<i8").tobytes(), m.tobytes())
    assert (search.scanned, search.skipped) == (2, 6)
    for k in range(2):
        best = sorted(seen, key=lambda i: (-(seen[i] * pivots[k]).sum(), i))[:3]
        assert search.row[search.at == k].tolist() == best


def test_siblings_from_slices(spark):
    """Slices of an article give the same siblings as all pairs, also where rows share a clause or have none."""
    rows = [(i, "1/2024/NĐ-CP", 1 + i // 40, None if i % 11 == 0 else 1 + (i * 7) % 13, "hình thức xử phạt bổ sung" if i % 9 == 0 else "x") for i in range(120)] + [(120, "", 1, 1, "x"), (121, None, 1, 1, "x"), (122, "2", 0, 1, "x")]
    p = spark.createDataFrame(rows, "row_id long, so_hieu string, dieu_so int, khoan_so int, page_content string")
    hits = p.select(F.col("row_id") % 5, F.row_number().over(W.partitionBy(F.col("row_id") % 5).orderBy(F.col("row_id") * 37 % 101)), "row_id", F.lit(0.5), F.lit(False)).toDF("query_id", "pos", "row_id", "score", "is_sibling").filter("pos <= 4")
    hits = stored(hits, "hits")
    want = {tuple(r) for r in R.attach_siblings(hits, R.build_sibling_map(p)).collect()}
    assert len(want) > 100
    for size in (7, 1024):
        assert {tuple(r) for r in R.attach_index_siblings(hits, p, R.clause_index(p, size)).collect()} == want


def test_several_references(spark):
    """Hits of several references in order of the first that has them, each row once."""
    rows = [(0, "7/2024/NĐ-CP", 4, 1, "a"), (1, "7/2024/NĐ-CP", 4, 1, "b"), (2, "7/2024/NĐ-CP", 11, None, None), (3, "8/2024/NĐ-CP", 4, 1, "a")]
    p = spark.createDataFrame(rows, "row_id long, so_hieu string, dieu_so int, khoan_so int, diem string")
    q = spark.createDataFrame([(1, "Điều 11, điểm B khoản 1 Điều 4 và Điều 4 và Điều 11 Nghị định 7/2024/NĐ-CP"), (2, "Điều 4"), (3, "Điều 9 và khoản 1 điều 4 nghị định 8")], "query_id long, text string")
    refs = R.extract_legal_refs(q, R.short_numbers(p))
    assert refs.filter("query_id = 1").count() == 3
    got = sorted((r["query_id"], r["pos"], r["row_id"]) for r in R.resolve_explicit_refs(refs, p).collect())
    assert got == [(1, 1, 2), (1, 2, 1), (1, 3, 0), (3, 1, 3)]


def test_row_ids_of_keys_with_a_common_prefix(spark):
    rows = spark.range(3000).select(F.concat(F.lit("văn bản số "), (F.col("id") % 700).cast("string")).alias("doc_key"), F.floor(F.col("id") / 700).alias("chunk_seq"), F.col("id").alias("page_content"))
    got = C.assign_row_ids(rows).orderBy("row_id").collect()
    want = sorted((r["doc_key"], r["chunk_seq"]) for r in rows.collect())
    assert [(r["doc_key"], r["chunk_seq"]) for r in got] == want and [r["row_id"] for r in got] == list(range(3000))
    one = numbered(spark.range(5000).repartition(4).withColumn("__at", F.lit("x")), [F.desc("id")], "n", 1)
    assert one.columns == ["id", "__at", "n"] and one.filter("n <> 5000 - id").isEmpty() and one.count() == 5000
    # One document's rows go by ranges like those of many.
    alone = C.assign_row_ids(rows.withColumns({"doc_key": F.lit("k"), "chunk_seq": F.col("page_content")}))
    assert alone.filter("row_id <> chunk_seq").isEmpty()
    assert C.assign_row_ids(rows.limit(0)).count() == 0


def test_statistics_after_a_change(spark, texts):
    gone = texts.filter("row_id % 10 = 1").unionByName(texts.filter("row_id % 10 = 2"))
    new = texts.filter("row_id % 10 = 2").withColumn("page_content", F.concat("page_content", F.lit(" từ1 mới mới"))).union(spark.createDataFrame([(5000, "hoàn toàn mới"), (5001, "")], "row_id long, page_content string"))
    after = texts.join(gone.select("row_id"), "row_id", "left_anti").unionByName(new)
    counts, stats = B.apply_counts(B.term_counts(texts), B.counts_delta(gone, new)), B.apply_stats(B.corpus_stats(texts), gone, new)
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in B.term_counts(after).collect()}
    assert stats.collect() == B.corpus_stats(after).collect()
    near = lambda df: {r["term"]: (r["df"], round(r["idf"], 9)) for r in df.collect()}
    assert near(B.term_idf(counts, stats)) == near(B.term_stats(B.postings(after), B.corpus_stats(after)))


POINTS = "row_id long, version long, text string"


def test_point_table(spark, tmp_path):
    path = f"file://{tmp_path}/points"
    batch = lambda rows: spark.createDataFrame(rows, POINTS)
    assert PT.apply_points(batch([(i, 0, f"a{i}") for i in range(50)] + [(3, 2, "late"), (3, 1, "early")]), path, version="version", number=0, buckets=8)
    first = PT.current(spark, path)
    assert not PT.apply_points(batch([(3, 9, "again")]), path, version="version", number=0)
    assert PT.apply_points(batch([(3, 0, "older"), (77, 0, "new")]), path, version="version", number=1)
    got = {r["row_id"]: r["text"] for r in PT.read_points(spark, path).collect()}
    assert got == {**{i: f"a{i}" for i in range(50)}, 3: "older", 77: "new"}
    now = PT.current(spark, path)
    # Two rows touch two buckets at most; the others are the folders of before.
    assert sum(first["where"].get(b) != f for b, f in now["where"].items()) <= 2 and now["version"] == 2
    with pytest.raises(Exception, match="exist"):
        PT._publish(spark, path, now)
    with pytest.raises(ValueError):
        PT.apply_points(batch([(1, 1, "x")]).withColumnRenamed("text", "other"), path)
    assert PT.apply_points(batch([]), path, number=2) and PT.read_points(spark, path).count() == 51
    # A manifest that is not whole yet is not seen.
    (tmp_path / "points/manifests/000000000009.json").write_text('{"version": 9, "wh')
    assert PT.current(spark, path)["version"] == 3
    (tmp_path / "points/manifests/000000000009.json").unlink()
    PT.apply_points(batch([(i, 0, "b") for i in range(60)]), path)
    assert PT.vacuum(spark, path, keep=1) >= 2 and PT.read_points(spark, path).count() == 61


def test_stream_upserts(spark, tmp_path):
    for i, rows in enumerate([[(1, 0, "a"), (2, 0, "b")], [(2, 1, "c"), (3, 1, "d"), (3, 0, "old")]]):
        spark.createDataFrame(rows, POINTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{i}")
    path, check = f"file://{tmp_path}/points", f"file://{tmp_path}/check"
    PT.apply_points(spark.createDataFrame([(9, 0, "was here")], POINTS), path, buckets=4)
    for part in ("0", "{0,1}", "{0,1}"):
        updates = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/{part}")
        stream_upserts(updates, path, check if part != "0" else f"{check}0", source=part).awaitTermination()
    assert {r["row_id"]: r["text"] for r in PT.read_points(spark, path).collect()} == {1: "a", 2: "c", 3: "d", 9: "was here"}


def test_ledger(spark, tmp_path):
    path, calls = f"file://{tmp_path}/ledger", tmp_path / "calls"
    calls.mkdir()

    def make():
        import uuid

        def model(pdf):
            for p in pdf["prompt"]:
                if len(pdf) > 1 and "bad" in list(pdf["prompt"]):
                    raise ValueError("one by one")
                (calls / uuid.uuid4().hex).write_text(p)
                if p == "bad":
                    raise ValueError("no answer")
            return [len(p) for p in pdf["prompt"]]

        return model

    said = lambda: sorted(f.read_text() for f in calls.iterdir())
    df = spark.createDataFrame([(1, "one"), (2, "three"), (3, "one"), (4, None), (5, "bad")], "id long, p string")
    got = {r["id"]: (r["n"], r["error"]) for r in L.ask(df, F.col("p"), "m", make, path, "n", "long", waves=3).collect()}
    assert got == {1: (3, None), 2: (5, None), 3: (3, None), 4: (None, None), 5: (None, "no answer")}
    assert said() == ["bad", "one", "three"]
    more = df.union(spark.createDataFrame([(6, "seven"), (7, "three")], "id long, p string"))
    again = L.ask(more, F.col("p"), "m", make, path, "n", "long")
    assert {r["id"]: r["n"] for r in again.collect()} == {1: 3, 2: 5, 3: 3, 4: None, 5: None, 6: 5, 7: 5}
    assert said() == ["bad", "bad", "one", "seven", "three"]
    L.ask(df, F.col("p"), "other", make, path, "n", "long").collect()
    assert said().count("one") == 2


def test_chunk_files_keep_keys_and_order(spark, tmp_path):
    meta = spark.createDataFrame([("007", i) for i in range(30)] + [("7", 0), ("ăn", 1), ("ăn", 0), ("a/b=c", 0)], "doc_key string, chunk_seq int")
    kind = CF.CHUNK.split(", page_content")[0].removeprefix("metadata ")
    chunks = meta.withColumn("metadata", F.from_json(F.to_json(F.struct(F.concat("doc_key", F.lit(":"), "chunk_seq").alias("chunk_id"))), kind))
    chunks = chunks.withColumns({"page_content": F.concat(F.lit("x\n"), "chunk_seq"), "noi_dung_tham_chieu": F.array(F.lit("đ"))})
    CF.write_chunks_per_document(chunks, f"file://{tmp_path}/each")
    back = CF.read_chunks_per_document(spark, f"file://{tmp_path}/each")
    pairs = sorted((r["doc_key"], r["chunk_seq"]) for r in meta.collect())
    assert sorted((r["doc_key"], r["chunk_seq"]) for r in back.collect()) == pairs
    CF.merge_chunks(back, f"file://{tmp_path}/all")
    merged = CF.read_merged(spark, f"file://{tmp_path}/all").orderBy("line").collect()
    assert [r["metadata"]["chunk_id"] for r in merged] == [f"{k}:{s}" for k, s in pairs] and [r["line"] for r in merged] == list(range(len(pairs)))


def test_bm25_topk_shuffles_no_postings(spark, texts, asked):
    """Every task hands on its best rows only, and they are those of scoring all pairs, for queries in one part or many."""
    posts, stats = stored(B.postings(texts), "p"), B.corpus_stats(texts)
    every = B.pad_zero_scores(B.bm25_scores(posts, B.term_stats(posts, stats), stats, asked), texts, asked, 7)
    want = {tuple(r) for r in B.rank_hits(every, 7).select("query_id", "row_id", F.round("score", 9), "rank").collect()}
    top = B.bm25_topk(texts, asked, 7)
    assert {tuple(r) for r in top.select("query_id", "row_id", F.round("score", 9), "rank").collect()} == want and len(want) == 35
    assert "SortMergeJoin" not in (plan := top._jdf.queryExecution().executedPlan().toString()) and "Generate" not in plan and "HashJoin" not in plan
    tokens, weights, avgdl = B.search_input(texts, asked)
    parted = B.rank_hits(BS.searched(tokens, asked, weights, avgdl, 7, BS.scan_rows, most=100), 7)
    assert {tuple(r) for r in parted.select("query_id", "row_id", F.round("score", 9), "rank").collect()} == want
    assert B.bm25_topk(texts.limit(0), asked).count() == B.bm25_topk(texts, asked.limit(0)).count() == 0
    blank = texts.select("row_id", F.lit(None).cast("string").alias("page_content"))
    assert [r["row_id"] for r in BI.bm25_block_topk(blank, asked.filter("query_id = 1"), 3).orderBy("rank").collect()] == [0, 1, 2]


def test_chunk_files_follow_size(spark, tmp_path):
    """Chunks of many documents are a few files, each of whole documents in order; ids are given without shuffling or storing texts."""
    rows = spark.range(900).select((F.col("id") % 300).cast("string").alias("doc_key"), F.floor(F.col("id") / 300).cast("int").alias("chunk_seq"))
    meta = F.from_json(F.lit('{"dieu_so": 1}'), CHUNK.split(", page_content")[0].removeprefix("metadata ")).alias("metadata")
    chunks = rows.select("*", meta, F.concat("doc_key", F.lit(" "), "chunk_seq").alias("page_content"), F.array().cast("array<string>").alias("noi_dung_tham_chieu"))
    CF.write_chunks_per_document(chunks, f"file://{tmp_path}/each")
    assert not [p for p in (tmp_path / "each").iterdir() if p.is_dir()] and len(list((tmp_path / "each").glob("part-*"))) <= 8
    back = CF.read_chunks_per_document(spark, f"file://{tmp_path}/each").select("doc_key", "chunk_seq", "page_content", F.col("_metadata.file_name").alias("file"))
    assert {tuple(r)[:3] for r in back.collect()} == {tuple(r) for r in chunks.select("doc_key", "chunk_seq", "page_content").collect()}
    assert back.groupBy("doc_key").agg(F.countDistinct("file").alias("n")).filter("n > 1").isEmpty()
    twice = chunks.unionByName(chunks.filter("doc_key = '5'"))
    got = C.assign_row_ids(twice)
    assert [r["row_id"] for r in got.orderBy("row_id").collect()] == list(range(903))
    assert "page_content" not in got.select("row_id")._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_split_files(spark, tmp_path):
    """Lines of plain files that are read in several splits, several to a task, are numbered in order; nothing is stored or shuffled for it."""
    rows = [f'{{"metadata": {{"chunk_id": "{f:02d}:{i}"}}, "page_content": "{"x" * (i % 50)}", "noi_dung_tham_chieu": []}}' for f in range(3) for i in range(400)]
    for f in range(3):
        (tmp_path / f"part-{f}.json").write_text("\n\n".join(rows[400 * f : 400 * f + 400]) + "\n")
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        merged = CF.read_merged(spark, f"file://{tmp_path}")
        got = merged.orderBy("line").collect()
        assert merged.rdd.getNumPartitions() > 3
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert [(r["line"], r["metadata"]["chunk_id"]) for r in got] == [(400 * f + i, f"{f:02d}:{i}") for f in range(3) for i in range(400)]
    assert not any("page_content" in x for x in merged._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)


def test_contexts_from_slices(spark):
    """Contexts made in slices of points are those of dealing every text out by question: hits in one slice or several, of rows that are not there, ids with gaps, none."""
    rng = np.random.default_rng(8)
    rows = [(int(i), f"{i % 3}/2024", f"văn bản {i % 3}", int(i) % 5, None if i % 4 else 2, None if i % 3 else "a", f"text {i}'s\n{'x' * (int(i) % 9)}") for i in range(60) if i % 7]
    p = spark.createDataFrame(rows, "row_id long, so_hieu string, ten_van_ban string, dieu_so int, khoan_so int, diem string, page_content string")
    refs = spark.createDataFrame([(i, ["Phụ lục I: it's", "b\\c"]) for i in (1, 8, 30)], "row_id long, refs array<string>")
    hits = []
    for k in range(40):
        near = int(rng.integers(0, 60))
        ids = rng.permutation(60)[: k % 4] if k % 2 else rng.permutation(np.arange(near - near % 8, near - near % 8 + 8))[: k % 5]
        hits += [(k, n + 1, int(i), bool(n % 2)) for n, i in enumerate(ids)]
    hits = spark.createDataFrame(hits, "query_id long, pos int, row_id long, is_sibling boolean")
    q = spark.range(42).select(F.col("id").alias("query_id"), F.lit("hỏi").alias("text"))
    full = p.join(refs.withColumnRenamed("refs", "noi_dung_tham_chieu"), "row_id", "left")
    want = {r["query_id"]: r["context"] for r in A.build_context(R.attach_payload(hits, full), q).collect()}
    for size in (8, 64):
        got = A.contexts(q, hits, p, refs, size).collect()
        assert len(got) == 42 and {r["query_id"]: r["context"] for r in got} == want and {r["text"] for r in got} == {"hỏi"}
    assert len({c for c in want.values()}) > 20 and want[41] == A.NO_CONTEXT


def test_vectors_are_dealt_out_as_given(spark):
    """Vectors of single precision take four bytes a number until they are in blocks; those are unit vectors, whichever precision was given."""
    from lexforge.sources import stage

    v, rows = vectors_of(spark, 300, np.random.default_rng(3))
    rows = rows.withColumnRenamed("id", "row_id")
    for df, size in ((rows, 4), (rows.select("row_id", F.col("embedding").cast("array<double>").alias("embedding")), 8)):
        before = len(stage._stored)
        blocks = DI.pivot_blocks(df, DI.unit(v[:3].astype(np.float64)), 50)
        kept = [p for p in stage._stored[before:] if "/assigned-" in p]
        assert spark.read.parquet(kept[0]).filter(F.length("v") != size * 16).isEmpty()
        got = {int(i): x for r in blocks.collect() for i, x in zip(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["matrix"]).reshape(-1, 16), strict=True)}
        assert len(got) == 300 and all((got[i] == u).all() for i, u in enumerate(DI.unit(v.astype(np.float64))))
