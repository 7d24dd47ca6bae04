"""Fill-in-middle, importance resampling and the WARC archive against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexforge.llm import fill_in_middle, importance, warc

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(x):
    return "" if x is None else str(x)


def rearranged(i, text, seed=1):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"{seed}:{key(i)}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, corpus, empty):
    odd = [(1000 + i, t) for i, t in enumerate(["<S", "a<P>b", "<" * 9, "<<S<M", "é\x00\r\n日本 a1", ">S>", "x" * 100_000, "a b\n" * 50_000, " "] * 12)]
    docs = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    made = fill_in_middle.fill_in_middle(docs).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    want = Counter(rearranged(r["doc_id"], r["text"] or "") for r in docs.collect())
    assert Counter(tuple(r)[:-1] for r in made) == want and {r["form"] for r in made} == {"plain", "psm", "spm"}
    texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert Counter((r["doc_id"], r["back"]) for r in made) == texts
    assert fill_in_middle.fill_in_middle(corpus).count() == corpus.count() and fill_in_middle.fill_in_middle(empty).count() == 0
    named = fill_in_middle.fill_in_middle(corpus.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), seed=7, rate=100, spm=100).collect()
    assert {r["form"] for r in named if r["output"]} == {"spm"}


def test_pieces_of_a_batch():
    texts = pa.array(["a" * n for n in (5, 0, 3, 90, 1, 1, 0)])
    got = list(fill_in_middle.pieces(texts, 10))
    assert [x for lo, n in got for x in range(lo, lo + n)] == list(range(7)) and all(n == 1 or sum(len(str(t)) for t in texts.slice(lo, n)) <= 10 for lo, n in got)


def test_crc_algebra():
    rng = np.random.default_rng(1)
    texts = ["", "A1 b", "x" * 70, "é" * 40 + " " + "q" * 5000 + "/z " + "ü", "no,end", "end"] + ["".join(rng.choice(list("ab Z9-é\x00"), 60)) for _ in range(50)]
    held = pa.array([t.encode() for t in ["skipped over", *texts]], pa.binary()).slice(1)
    grams, begin, end = importance.ngram_crcs(held)
    for k, t in enumerate(texts):
        w = WORDS.findall(t.translate(LOWER))
        assert end[k] - begin[k] == len(w)
        for n in (1, 2, 3):
            want = [zlib.crc32(" ".join(w[i : i + n]).encode()) for i in range(len(w) - n + 1)]
            assert grams[n - 1][begin[k] : max(begin[k], end[k] - n + 1)].tolist() == want
    lengths = np.array([0, 1, 63, 64, 65, 4096, 70_001])
    assert importance.shift(np.full(7, 0xDEADBEEF, dtype=np.uint32), lengths).tolist() == [
        zlib.crc32(b"\0" * int(n), 0xDEADBEEF ^ 0xFFFFFFFF) ^ 0xFFFFFFFF if n else 0xDEADBEEF for n in lengths
    ]


def features(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_importance_resampling(spark, corpus, empty):
    target = spark.createDataFrame([("w1 w2 w3 changed w5",), (None,), ("w7 W8 w9 " * 30,)], "text string")
    docs = [(r["doc_id"], *features(r["text"])) for r in corpus.select("doc_id", "text").collect()]
    s, t = Counter(b for *_, f in docs for b in f), Counter(b for r in target.collect() for b in features(r["text"])[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))

    def noise(i):
        h = int(hashlib.sha256(f"42:{key(i)}".encode()).hexdigest()[:8], 16)
        return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    scored = [(i, n, len(f), w := sum(map(gain, f)), w + noise(i)) for i, n, f in docs]
    may = sorted((x for x in scored if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for percent in (5, 60):
        got = importance.resample(corpus, target, percent=percent).collect()
        assert Counter(tuple(r)[:5] for r in got) == Counter(scored)
        drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
        assert [r["rank"] for r in drawn] == list(range(1, percent * len(may) // 100 + 1))
        assert [(r["doc_id"], r["score"]) for r in drawn] == [(x[0], x[4]) for x in may[: len(drawn)]]
    assert importance.resample(empty, target).count() == 0
    alone = importance.resample(corpus, target.limit(0)).collect()
    assert len(alone) == len(docs)


def pages_of(spark):
    long, other = "<p>đoạn</p>\r\n\r\n" * 20, "y" * 100
    rows = [
        (5, "http://a/1", long), (3, "http://a/2", long), (9, None, long), (4, "http://b/\r\nX: 1", other), (4, "http://b/\r\nX: 1", other), (7, "u", "z" * 99), (8, "u", "z" * 99),
        (None, "http://n", other), (None, "http://m", "q" * 300), (None, "http://m", "q" * 300), (11, "e", None), (12, "e", ""), (13, "big", "é\n" * 200_000), (14, "WARC/1.1", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def wanted(rows):
    first = {}
    for r in rows:
        t = r["html"] or ""
        first[t] = min(first.get(t, math.inf), math.inf if r["page_id"] is None else r["page_id"])
    for r in rows:
        t = r["html"] or ""
        data, least = t.encode(), None if first[t] == math.inf else first[t]
        again = len(data) >= 100 and r["page_id"] != least
        yield (key(r["page_id"]) or None, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", key(least) if again else None, None if again else data)


def test_warc(spark, tmp_path):
    pages = pages_of(spark)
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages.withColumn("digest", F.lit(1)), path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r["html"] or "" for r in pages.collect()})
    fields = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    plain = lambda rows: Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows)
    assert plain(warc.read_archive(spark, path).select(*fields).collect()) == Counter(wanted(pages.collect()))
    # The same from files, and the files byte for byte.
    warc.write_files(spark, path, f"file://{tmp_path}/files", per_file=3)
    back = warc.read_files(spark, f"file://{tmp_path}/files")
    kept = F.when(F.col("record_type") == "response", F.col("payload"))
    assert plain(back.select("record_id", "length_said", "digest_said", "record_type", "refers_to", kept).collect()) == Counter(wanted(pages.collect()))
    records = plain(warc.rebuild(spark, path).select("record").collect())
    assert plain(back.select("record").collect()) == records
    one = next(r[0] for r in records if b"<urn:page:3>\r\nWARC-Target" in r[0])
    head, block = one.split(b"\r\n\r\n", 1)
    assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(block) - 4 and block.endswith(b"\r\n\r\n") and head.startswith(b"WARC/1.1\r\n")


def test_warc_checks_and_empty(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages_of(spark), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.when(F.col("size") == 300, F.lit(b"q" * 299 + b"r")).otherwise(F.col("payload")))
    bad.write.parquet(f"file://{tmp_path}/bad/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"file://{tmp_path}/bad/records")
    try:
        warc.read_archive(spark, f"file://{tmp_path}/bad").collect()
        raise SystemError("a changed payload was not noticed")
    except Exception as e:  # noqa: BLE001
        assert "record and payload disagree" in str(e)
    warc.write_archive(pages_of(spark).limit(0), f"file://{tmp_path}/none")
    assert warc.read_archive(spark, f"file://{tmp_path}/none").count() == 0
