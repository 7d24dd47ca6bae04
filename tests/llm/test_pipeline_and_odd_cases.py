"""The pipeline stage by stage against plain versions, and odd inputs of single operators."""

import datetime as dt
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexforge.llm import mixture, near_dedup, quality_rules, secrets, toxicity, url_filters
from lexforge.llm.common import lookup, pieces
from lexforge.llm.queries import tokenizer_path
from lexforge.llm.shingles import WordHashes, plain_word

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_classes(texts):
    """Class number of each text: all pairs by alignment, then components."""
    hashes = WordHashes(plain_word)
    grams = [near_dedup.text_shingles(t.encode(), hashes) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.similarity(grams[i], grams[j]) >= 0.8:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_pipeline_against_plain_versions(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {}
    for name in list(stages)[:-1]:
        docs = stages[name](spark, docs, SF).cache()
        kept[name] = docs.collect()
    ids = lambda name: Counter(r["doc_id"] for r in kept[name])
    assert all(rows[r["doc_id"]] == r for name in kept for r in kept[name])

    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["toxicity"] for r in toxicity.score(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), model).collect()}
    toxic = {i for i, s in scores.items() if s >= 0.5}
    assert ids("toxicity") == Counter(rows.keys() - toxic)
    marked = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(marked.get(i) == 0 for i in toxic) <= 0.02 * len(rows)  # too few labels here to measure recall

    last = {}
    for i in sorted(rows.keys() - toxic):
        last[rows[i]["text"] or ""] = i
    assert ids("exact_dedup") == Counter(last.values())

    order = sorted(last.values())
    first = {}
    for i, c in zip(order, near_classes([rows[i]["text"] or "" for i in order]), strict=True):
        first.setdefault(c, i)
    assert ids("near_dedup") == Counter(first.values())

    sizes = {i: len(WORD.findall(rows[i]["text"] or "")) for i in first.values()}
    by = defaultdict(list)
    for i in sizes:
        by[rows[i]["source"]].append(i)
    names = sorted(s for s in by if s is not None) + [None] * (None in by)
    whole = {s: sum(sizes[i] for i in by[s]) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(whole.values()), set(names)
    while over := {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * whole[s]}:
        target |= {s: 2.0 * whole[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    times = ids("mixture")
    assert set(times) <= set(sizes) and max(times.values()) <= 2
    for s in names:
        taken, full = sum(times[i] * sizes[i] for i in by[s]), int(target[s] // whole[s])
        sums = 1
        for i in by[s]:
            sums |= sums << sizes[i]
        budget = round(target[s] - full * whole[s])
        assert taken - full * whole[s] == (sums & ((1 << (budget + 1)) - 1)).bit_length() - 1

    tk = Tokenizer.from_file(tokenizer_path())
    tokens = {i: len(tk.encode(rows[i]["text"] or "", add_special_tokens=False).ids) + 1 for i in times}
    pieces = stages["packing"](spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == times
    total, places = Counter(), defaultdict(list)
    for r in pieces:
        total[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert total == Counter({i: n * times[i] for i, n in tokens.items()})
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_budget_of_equal_lengths():
    """A million documents of one length and an odd one: memory does not follow their words."""
    for lengths, counts in (([7, 512], [1, 10**6]), ([7, 20_000], [1, 10**6]), ([999, 1000], [10**6, 10**6]), ([512], [10**6])):
        n, c = np.array(lengths), np.array(counts)
        total = int((n * c).sum())
        for budget in (total // 3, total // 2 + 3):
            tracemalloc.start()
            take = mixture.fit_budget(n, c, budget)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            left = budget - int((take * n).sum())
            odd = {budget % lengths[-1], (budget - 7) % lengths[-1]} if lengths[0] == 7 else {budget % 512} if lengths == [512] else {0}
            assert peak < 200e6 and (take <= c).all() and left == min(odd)


def test_budget_against_all_sums():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = np.unique(rng.integers(0, int(rng.choice([6, 12, 40])), int(rng.integers(1, 5))) * int(rng.choice([1, 3])))
        c = rng.integers(0, int(rng.choice([3, 30, 300])), len(n))
        total, sums = int((n * c).sum()), 1
        for x, k in zip(n.tolist(), c.tolist(), strict=True):
            for _ in range(k):
                sums |= sums << x
        for budget in {0, total // 3, total // 2, max(total - 1, 0)}:
            take = mixture.fit_budget(n, c, budget)
            assert (take >= 0).all() and (take <= c).all() and int((take * n).sum()) == (sums & ((1 << (budget + 1)) - 1)).bit_length() - 1


def test_mixture_of_one_long_document(spark):
    """A document longer than its source's budget is not taken once more than fits."""
    docs = spark.createDataFrame([(1, "w " * 5000, "a"), (2, "w w w", "a"), (3, "x " * 40, "b"), (4, "y " * 41, "c")], "doc_id long, text string, source string")
    plan = {r["doc_id"]: r for r in mixture.mixture_plan(docs).collect()}
    for s, ids in (("a", (1, 2)), ("b", (3,)), ("c", (4,))):
        taken = sum(plan[i]["times"] * plan[i]["size"] for i in ids)
        assert taken <= round(plan[ids[0]]["target"]) and all(plan[i]["times"] <= 2 for i in ids)


def test_url_filters_as_of(spark):
    """Captures against a plain reading of the dated entries; clashing names, repeated and hot captures."""
    rng = np.random.default_rng(1)
    hosts = ["a.example.com", "example.com", "b.a.example.com", "other.org", "localhost"]
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=int(n))
    entries = [(str(rng.choice(["ads", "spam"])), str(rng.choice(hosts)), str(rng.choice(["/", "/en", "/en/", "/e"])), day(rng.integers(0, 40)), str(rng.choice(["add", "remove"]))) for _ in range(150)]
    rows = [(int(i), f"http://{rng.choice(hosts) if i % 3 else 'a.example.com'}{rng.choice(['', '.'])}{rng.choice(['', '/', '/en', '/en/x', '/english', '/e?q=1'])}", day(rng.integers(0, 45))) for i in range(400)]
    rows += rows[:20]

    def active(url, at):
        host, path = re.match(r"http://([^/?]+?)\.?(?=[/?]|$)([^?]*)", url).groups()
        path = path.removeprefix(".") or "/"
        state = {}
        for name, domain, prefix, since, action in sorted(entries, key=lambda e: (e[3], e[4])):
            covered = host == domain or ("." in domain and host.endswith("." + domain))
            under = path == prefix or path.startswith(prefix if prefix.endswith("/") else prefix + "/")
            if covered and under and since <= at:
                state[name, domain, prefix] = action
        on = [k for k, v in state.items() if v == "add"]
        return len(on), ",".join(sorted({k[0] for k in on}))

    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at date").withColumns({c: F.lit("x") for c in ("host", "path", "part", "copies", "list_name", "id", "domain")})
    listed = spark.createDataFrame(entries, "list_name string, domain string, prefix string, at date, action string")
    got = Counter((r["page_id"], r["n_active"], r["lists"], r["blocked"]) for r in url_filters.judge_captures(captures, listed).collect())
    want = Counter()
    for i, url, at in rows:
        n, lists = active(url, at)
        want[i, n, lists, n > 0] += 1
    assert got == want and any(k[1] > 1 for k in got)


def test_toxicity_of_repeated_ids(spark):
    """Rows that share an id are scored each by its own text."""
    words = lambda k, bad: " ".join([f"w{(k * 7 + j) % 50}" for j in range(12)] + (["awful", "nasty"] if bad else ["kind", "nice"]))
    docs = [(i, words(i, i % 2)) for i in range(200)] + [(i, words(i + 3, i % 2)) for i in range(30)] + [(7, None), (None, "awful nasty")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(df, toxicity.train(df, labels)).collect()
    assert Counter(r["doc_id"] for r in scored) == Counter(i for i, _ in docs) and all(0 <= r["toxicity"] <= 1 for r in scored)


def test_secrets_of_a_long_text(spark):
    key = "AKIA" + "Q7" * 8
    text = "plain words. " * 200_000 + f"token = {key} end " + "0a" * 20_000
    docs = spark.createDataFrame([(1, text), (2, "é" * 300_000 + " password: hunter2hunter2")], "doc_id long, text string")
    found = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["found"]] for r in secrets.findings_by_path(*(lambda p, _, f: (p, f))(*secrets.scan_versions(docs))).collect()}
    at = text.index("token")
    assert ("assign", at, at + len(f"token = {key}")) in found[1] and ("access", text.index(key), text.index(key) + len(key)) in found[1]
    assert ("hex", len(text) - 40_000, len(text)) in found[1] and found[2] == [("assign", 300_001, 300_001 + len("password: hunter2hunter2"))]


def test_rule_limit_with_decimals(spark):
    rules = (quality_rules.Rule("few_repeats", "repeat_percent", high=33.5),)
    text = lambda n: " ".join(["a b c"] * 2 + [f"w{i}" for i in range(n)])  # noqa: E731  six repeated words
    docs = spark.createDataFrame([(n, text(n)) for n in (11, 12, 13)], "doc_id long, text string")
    got = {r["doc_id"]: r["base_failed"] for r in quality_rules.quality_verdicts(docs, base_rules=rules).collect()}
    measured = {r["doc_id"]: 100 * r["n_repeat_words"] > 33.5 * r["n_words"] for r in quality_rules.measures(docs).collect()}
    assert got == measured and len(set(got.values())) == 2


def test_no_broadcast_of_tables_sized_too_low(spark):
    """Spark sizes exploded rows as those they come from; neither a lookup nor the candidates broadcast them."""
    few = spark.range(2000).withColumnRenamed("id", "rep")
    rows = few.select("rep", F.explode(F.sequence(F.lit(0), F.lit(200))).alias("value"))
    sizes = rows.groupBy("value").agg(F.count(F.lit(1)).alias("size"))
    members = rows.select("value", "rep", F.lit(5).alias("n"), F.lit(2).alias("size"))
    for df in (lookup(rows, sizes, ["value"], ["rep"]), near_dedup._candidates(members, 8, 0.8)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_near_dedup_moves_texts_once(spark):
    """The rows that stay are found with one exchange and one sort of the texts; Python holds a few texts and words at a time."""
    rows = [(1, "a b", "x"), (1, "a b", "y"), (None, "c d", "x"), (None, "c d", "x"), (2, "a b", "z"), (3, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = near_dedup.near_dedup(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString().split("SortAggregate")[0]
    assert "ShuffledHashJoin" in plan and plan.count("Exchange") <= 3 and "SortMergeJoin" not in plan
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "c d"), (1, "a b"), (3, None)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200))], ["i"])
    assert [p.num_rows for p in pieces(batch)] == [512, 512, 176] and near_dedup.WORDS_KEPT <= 100_000
