"""Each operator against a brute-force version, on texts with every odd case, and on an empty table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import exact_dedup, mixture, near_dedup, packing, quality_rules, secrets, substring_dedup, tokens, toxicity, url_filters
from lexforge.llm.queries import tokenizer_path
from lexforge.llm.shingles import WordHashes, plain_word

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(corpus):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in corpus.select("doc_id", "text", "source").collect()]


def test_exact_dedup(corpus, empty):
    rows = texts_of(corpus)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t].append(i)
    got = exact_dedup.dedup_decisions(corpus, keep="largest", runs=16).collect()
    assert len(got) == len(rows)
    by_digest = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[bytes(r["digest"])]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.exact_dedup(corpus)
    assert kept.columns == corpus.columns and kept.count() == len(groups) and set(kept.collect()) <= set(corpus.collect())
    nulls = corpus.withColumn("doc_id", F.lit(None).cast("long")).repartition(5)
    assert exact_dedup.dedup_decisions(nulls, keep="smallest").filter("kept").count() == len(groups)
    assert exact_dedup.dedup_decisions(corpus.withColumn("doc_id", F.col("doc_id").cast("string"))).filter("kept").count() == len(groups)
    assert exact_dedup.dedup_decisions(empty).count() == 0


def test_quality_rules(corpus, empty):
    for r in quality_rules.quality_verdicts(corpus).join(corpus.select("doc_id", "text").distinct(), "doc_id").collect():
        t = r["text"] or ""
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines))), t[:60]
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert quality_rules.quality_verdicts(empty).count() == 0


def test_packing(corpus, empty):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(corpus, tokenizer_path(), capacity=256).collect()
    want = Counter()
    for i, t, _ in texts_of(corpus):
        ids = tk.encode(t, add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 256)):
            part = ids[s : s + 256]
            want[i, p, s, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= 256
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 256) * 1.05 + 1
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0
    assert packing.pack_documents(corpus.withColumn("doc_id", F.col("doc_id").cast("string")), tokenizer_path()).count() > 0


@pytest.mark.parametrize("n", [5, 3000])
def test_program(n):
    """The fractions place every piece, stay in the capacity and come near a bound that no packing can beat."""
    rng = np.random.default_rng(n)
    lengths, counts = np.unique(np.minimum(128, np.exp(rng.normal(3, 1, n)).astype(int) + 1), return_counts=True)
    program, bound = packing.solve_program(lengths, counts, 128)
    placed = Counter()
    for configuration, times in program.items():
        assert times > 0 and sum(length * k for length, k in configuration) <= 128
        for length, k in configuration:
            placed[length] += k * times
    assert all(placed[k] >= c - 1e-6 for k, c in zip(lengths.tolist(), counts.tolist(), strict=True))
    assert (lengths * counts).sum() / 128 - 1e-9 <= bound <= sum(program.values()) + 1e-9
    if n > 100:
        assert sum(program.values()) <= 1.01 * bound


def test_chunk_encoder():
    from tokenizers import Tokenizer

    tk, enc = Tokenizer.from_file(tokenizer_path()), tokens.Encoder(tokenizer_path())
    for t in ["", " ", "don't we'll 'S x's. ÀÉ İstanbul ΣΑΣ ß ſ ª áb\xa0c d \x1c\x1d x\x85y 12a3,. ... !!", "a,b;c.. q.'s q'. 9. é. É!! ǅ."]:
        assert enc.ids(t.encode()) == np.array(tk.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_encoder_keeps_few_entries():
    """Caches that fill up keep the ids right and what they hold bounded."""
    from tokenizers import Tokenizer

    tk, enc = Tokenizer.from_file(tokenizer_path()), tokens.Encoder(tokenizer_path())
    for lo in range(0, 500_000, 50_000):
        text = " ".join(f"w{i}, the" for i in range(lo, lo + 50_000))
        got = enc.ids(text.encode())
        assert lo % 200_000 or got == np.array(tk.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert len(enc) + sum(len(x) for x in vars(enc).values() if isinstance(x, dict)) <= 600_000


def test_token_counts(corpus, empty):
    lengths = tokens.token_lengths(corpus, tokenizer_path())
    n = np.array([r["n_tokens"] for r in lengths.collect()])
    report = tokens.length_report(tokens.length_histogram(lengths), limits=(7, 64, 512, 100_000), block=16).collect()
    assert {r["limit"] for r in report} == {7, 64, 512, 100_000, *n.tolist()}
    for r in report:
        cut = np.sort(np.minimum(n, r["limit"]))
        assert (r["q50"], r["q90"], r["q99"]) == tuple(cut[int(np.ceil(q * len(n))) - 1] for q in (0.5, 0.9, 0.99))
        assert r["n_docs"] == (n == r["limit"]).sum() and r["tokens_over"] == n[n > r["limit"]].sum()
        assert r["truncated_total"] == np.minimum(n, r["limit"]).sum() and r["docs_upto"] == (n <= r["limit"]).sum()
        assert r["total_tokens"] == n.sum() and r["tokens_upto"] == n[n <= r["limit"]].sum()
    assert tokens.length_report(tokens.length_histogram(tokens.token_lengths(empty, tokenizer_path()))).count() == 0


def test_toxicity(spark, empty):
    rng = np.random.default_rng(1)
    plain = ["tree", "river", "stone", "cloud", "meadow", "garden", "window", "paper"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = [plain[k] for k in rng.integers(0, 8, 40)] + (["blockhead", "nitwit"] * 2 if bad else [])
        rows.append((i, " ".join(w), "x"))
        labels.append((i, 1, int(bad)))
    rows += [(1000, "tree river blockheadz stone nitwitt", "x"), (1001, None, "x"), (1002, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity string")
    lab = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    kept = toxicity.drop_toxic(docs, model)
    assert {(r["doc_id"], r["toxicity"]) for r in kept.collect()} == {(i, "x") for i in got if got[i] < 0.5} and kept.columns == docs.columns
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert got[1000] >= 0.5 and got[1001] == got[1002] and 0 <= got[1001] <= 1
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(docs.select("doc_id", "text"), lab.limit(0))
    assert set(r["toxicity"] for r in toxicity.score(docs.select("doc_id", "text"), none).collect()) == {0.0}


def test_near_dedup(corpus, empty):
    rows = texts_of(corpus)
    h = WordHashes(plain_word)
    s = [near_dedup.text_shingles(t.encode(), h) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if near_dedup.similarity(s[a], s[b]) >= 0.8:
                root[find(a)] = find(b)
    classes = defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        classes[find(k)].append(i)
    want = Counter((i, min((x for x in c if x is not None), default=None), len(c)) for c in classes.values() for i in c)
    for small in (1, 8):
        got = near_dedup.near_duplicates(corpus, small=small).collect()
        assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == want
    kept = near_dedup.near_dedup(corpus)
    assert kept.columns == corpus.columns and set(kept.collect()) <= set(corpus.collect()) and kept.count() == len(classes)
    assert near_dedup.near_dedup(corpus.withColumn("doc_id", F.col("doc_id").cast("string"))).count() == len(classes)
    assert near_dedup.near_duplicates(empty).count() == 0


def edited(words, at, tag):
    """The words with those at the places replaced by words of their own."""
    return " ".join(f"{tag}{i}" if i in at else w for i, w in enumerate(words))


def test_near_dedup_hub(spark):
    """Copies that are linked to one original only, which is in the class of the buckets' smallest id but is not that id."""
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(base, {(7 * i) % 60 + 5, (11 * i) % 50 + 80}, f"c{i}x")) for i in range(40)] + [(99, " ".join(base))]
    h = WordHashes(plain_word)
    s = [near_dedup.text_shingles(t.encode(), h) for _, t in rows]
    assert all(near_dedup.similarity(x, s[-1]) >= 0.8 for x in s) and near_dedup.similarity(s[0], s[1]) < 0.8
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=2).collect()
    assert {(r["class_id"], r["class_size"]) for r in got} == {(0, 41)}


def test_near_dedup_hot_parts(spark, monkeypatch):
    """A text in many pairs and a shingle in many texts are worked on in parts; the result is that of one part, and no cell has more pairs than its share."""
    monkeypatch.setattr(near_dedup, "PER_TEXT", 3)
    monkeypatch.setattr(near_dedup, "CELL", 2)
    base = [f"w{i}" for i in range(300)]
    groups = [[f"g{g}x{i}" if 100 <= i < 240 else w for i, w in enumerate(base)] for g in range(6)]
    rows = [(10 * g + j, " ".join(words[: 7 * j] + [f"v{g}_{j}"] + words[7 * j + 1 :])) for g, words in enumerate(groups) for j in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in near_dedup.near_duplicates(docs, small=2).collect()}
    assert got == {d: (d // 10 * 10, 10) for d, _ in rows}
    pairs = spark.createDataFrame([(0, i) for i in range(1, 31)] + [(i, 40) for i in range(30)], "a long, b long")
    dealt = near_dedup.parts_of_pairs(pairs)
    assert sorted(map(tuple, dealt.select("a", "b").collect())) == sorted(map(tuple, pairs.collect()))
    assert dealt.select("part_a").filter("a = 0").distinct().count() > 5 and dealt.select("part_b").filter("b = 40").distinct().count() > 5
    # Prefix rows of one frequent shingle, each text a component of its own but for two at home.
    prefixes = spark.createDataFrame([(1, 1, 7, r, 50, True) for r in range(9)], "low int, high int, gram long, rep long, n int, is_low boolean")
    roots = spark.createDataFrame([(0, 0), (1, 0)], "id long, root long")
    met = sorted(map(tuple, near_dedup.rare_pairs(prefixes, roots, 0.8).collect()))
    assert met == [(a, b) for a in range(9) for b in range(a + 1, 9) if (a, b) != (0, 1)]


def test_near_dedup_lengths(spark):
    """Long versions in a bucket that a short original leads."""
    h, base, n = WordHashes(plain_word), [f"w{i}" for i in range(100)], 0
    value = lambda t: near_dedup.sketch(near_dedup.text_shingles(t.encode(), h), 1, 1)[0]
    rows = [(0, " ".join(base))]
    while len(rows) < 14:
        n += 1
        text = " ".join(base + ["more"] + [f"x{i}" for i in range(50)] + [f"end{n}"])
        if value(text) == value(rows[0][1]):
            rows.append((len(rows), text))
        elif n == 40:
            base, rows, n = [w + "v" for w in base], [(0, " ".join(w + "v" for w in base))], 0
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=1, picks=1).collect()
    assert {(r["doc_id"], r["class_id"], r["class_size"]) for r in got} == {(0, 0, 1), *((i, 1, 13) for i in range(1, 14))}


def test_near_dedup_null_and_shared_ids(spark):
    base = [f"w{i}" for i in range(150)]
    t = [" ".join(base), edited(base, {70}, "a"), "one two three four five six", "six five four three two one", "seven eight", "nine ten"]
    rows = [(None, t[0]), (None, t[1]), (None, t[2]), (None, t[2]), (None, t[3]), (5, t[4]), (5, t[5]), (5, t[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == {(None, None, 2): 4, (None, None, 1): 1, (5, 5, 1): 1, (5, 5, 2): 2}
    kept = Counter(r["text"] for r in near_dedup.near_dedup(docs).collect())
    assert kept.pop(t[0], 0) + kept.pop(t[1], 0) == 1 and kept == Counter(t[2:])


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.permutation(40).astype(np.uint64)
        b = np.delete(a, rng.integers(0, 40, int(rng.integers(0, 8))))
        b = np.insert(b, rng.integers(0, len(b), 2), np.array([100, 101], dtype=np.uint64))
        best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = max(best[i, j] + (a[i] == b[j]), best[i, j + 1], best[i + 1, j])
        m = best[-1, -1]
        exact = m / (len(a) + len(b) - m)
        got = near_dedup.similarity(a, b)
        assert (got >= 0.8) == (exact >= 0.8) and (exact < 0.8 or got == exact)


@pytest.mark.parametrize("seed", range(3))
def test_fit_budget(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(0, 500, 60))
    counts = rng.integers(1, 9, len(lengths))
    total = int((lengths * counts).sum())
    sums = 1  # bit n: some choice has n words in all
    for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
        for _ in range(c):
            sums |= sums << n
    for budget in (0, 1, total // 3, total // 2, total - 1, total, total + 5):
        take = mixture.fit_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        best = (sums & ((1 << (budget + 1)) - 1)).bit_length() - 1
        assert int((take * lengths).sum()) == best


def test_mixture(corpus, empty):
    rows = texts_of(corpus)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not over:
            target.update({s: unit * weight[s] for s in open_})
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    plan = mixture.mixture_plan(corpus)
    got = plan.collect()
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["src"]] and abs(r["target"] - target[r["src"]]) < 1e-6 and 0 <= r["times"] <= 2
        taken[r["src"]] += r["times"] * r["size"]
    for s in order:
        full = int(target[s] // sizes[s])
        budget, sums = round(target[s] - full * sizes[s]), 1  # bit n: some choice has n words in all
        for r in got:
            if r["src"] == s:
                sums |= sums << r["size"]
        best = (sums & ((1 << (budget + 1)) - 1)).bit_length() - 1
        assert taken[s] - full * sizes[s] == best
    assert Counter(map(str, plan.collect())) == Counter(map(str, mixture.mixture_plan(corpus).collect()))
    mixed = mixture.mix_documents(corpus)
    assert mixed.columns == corpus.columns and set(mixed.collect()) <= set(corpus.collect())
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert words == +taken
    assert mixture.mix_documents(empty).count() == 0
    assert mixture.mixture_plan(empty).count() == 0


def test_substring_dedup(corpus, empty):
    rows = sorted({(i, t) for i, t, _ in texts_of(corpus) if i is not None})
    seen, want = set(), {}
    for i, t, _ in texts_of(corpus):
        if i is None:  # before all others
            w = WORD.findall(t)
            seen.update(tuple(w[s : s + 20]) for s in range(len(w) - 19))
    for i, t in rows:
        w, gone = WORD.findall(t), set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone.update(range(s, s + 20))
            seen.add(k)
        want[i] = (len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone))
    for r in substring_dedup.remove_repeats(corpus).filter("doc_id is not null").collect():
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"]]
        assert r["kept_sha256"] == hashlib.sha256(r["kept_text"].encode()).hexdigest()
    assert substring_dedup.remove_repeats(empty).count() == 0
    named = corpus.filter("doc_id is not null").withColumn("doc_id", F.format_string("d%05d", "doc_id"))
    plain = corpus.filter("doc_id is not null")
    key = lambda df: Counter((str(r["doc_id"])[-5:].lstrip("d0"), r["n_removed"], r["kept_sha256"]) for r in df.collect())
    assert Counter({(i.lstrip("0"), n, h): c for (i, n, h), c in key(substring_dedup.remove_repeats(plain)).items()}) == key(substring_dedup.remove_repeats(named))
    twins = plain.filter("doc_id = 5").withColumn("text", F.lit(" ".join(map(str, range(40))))).withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r["n_removed"] for r in substring_dedup.remove_repeats(twins.union(twins)).collect()) == [0, 40]


def test_anchors_are_shared():
    """Every repeated window has an anchor whose key occurs in each of its places."""
    from lexforge.llm.shingles import mix

    rng = np.random.default_rng(0)
    for _ in range(150):
        v = int(rng.integers(1, 30))
        p = rng.integers(1, v + 1, 20)
        docs = [mix(np.concatenate([rng.integers(1, v + 1, int(rng.integers(0, 30))), p, rng.integers(1, v + 1, int(rng.integers(0, 30)))]).astype(np.uint64)) for _ in range(2)]
        words, seps = substring_dedup.layout(docs)
        key, lo, hi = substring_dedup.anchors(words, seps, 20, substring_dedup.Prefix(words, substring_dedup.BASE))
        places = defaultdict(list)
        for d, s in zip(docs, seps[:-1], strict=True):
            for i in range(len(d) - 19):
                places[d[i : i + 20].tobytes()].append(int(s) + 1 + i)
        inside = lambda q: {(int(k), int(a - q)) for k, a, b in zip(key, lo, hi, strict=True) if a >= q and b <= q + 20}  # noqa: E731, B023
        for at in places.values():
            assert all(inside(at[0]) & inside(q) for q in at[1:])


def test_secrets(spark, empty):
    key = "AKIA" + "Q" * 16
    docs = spark.createDataFrame(
        [(1, f"é password = 'abcdefgh1' and {key}"), (2, "token: short"), (3, "0123456789abcdef" * 2 + " 😀 API-KEY api_key:" + "z" * 9), (4, None), (5, f"é password = 'abcdefgh1' and {key}"), (5, "x")],
        "doc_id long, text string",
    )
    paths, ledger, found = secrets.scan_versions(docs)
    got = {(r["doc_id"], tuple((x["kind"], x["start"], x["end"]) for x in r["found"])) for r in secrets.findings_by_path(paths, found).collect()}
    one = (("assign", 2, 23), ("access", 29, 49))
    assert got == {(1, one), (2, ()), (3, (("hex", 0, 32), ("assign", 43, 60))), (4, ()), (5, one), (5, ())}
    assert ledger.count() == 5 * len(secrets.RULES)
    more = docs.unionByName(spark.createDataFrame([(6, "hub ghp_" + "a" * 36)], docs.schema))
    todo = secrets.unseen_pairs(secrets.path_blobs(more), ledger).collect()
    assert [(r["doc_id"], len(r["todo"])) for r in todo] == [(6, len(secrets.RULES))]
    newer = (*secrets.BASE, secrets.SecretRule("github", 2, "ghp_a+"))
    assert {tuple(r["todo"]) for r in secrets.unseen_pairs(paths, ledger, newer).collect()} == {("github@2",)}
    assert secrets.findings_by_path(*secrets.scan_versions(empty)[::2]).count() == 0
    # A second scan with newer rules and one more path: only what is new is scanned, old versions' findings go.
    newer = (*secrets.BASE, secrets.SecretRule("github", 2, "ghp_a+"))
    old = secrets.scan_versions(more)
    paths, ledger, found = secrets.scan_versions(more, old[1], old[2], rules=newer)
    hits = [(x["kind"], x["start"], x["end"]) for r in secrets.findings_by_path(paths, found, newer).filter("doc_id = 6").collect() for x in r["found"]]
    assert hits == [("github", 4, 44), ("hex", 8, 44)] and ledger.count() == old[1].count() + 6
    assert found.filter("rule = 'github@1'").count() == 0


def test_stored_ledger(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token: abcdefgh"), (2, "nothing")], "doc_id long, text string")
    more = docs.unionByName(spark.createDataFrame([(3, "nothing"), (4, "x AKIA" + "Q" * 16), (None, "token: abcdefgh")], docs.schema))
    counts = lambda df: {r["doc_id"]: len(r["found"]) for r in df.collect()}
    assert counts(secrets.scan_into(docs, str(tmp_path))) == {1: 1, 2: 0}
    assert counts(secrets.scan_into(more, str(tmp_path))) == {1: 1, 2: 0, 3: 0, 4: 1, None: 1}
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == 3 * len(secrets.RULES)
    assert counts(secrets.scan_into(more, str(tmp_path))) == {1: 1, 2: 0, 3: 0, 4: 1, None: 1}
    assert spark.read.parquet(f"{tmp_path}/findings").count() == 2


def test_url_filters(spark):
    import datetime as dt

    day = lambda n: dt.date(2024, 1, n)
    pages = spark.createDataFrame(
        [(1, "http://a.b.example.com/x", day(5)), (2, "http://b.example.com/en/1", day(15)), (3, "https://U@B.example.com:80/en/", day(25)), (4, None, day(5)), (5, "http://b.example.com/x", None),
         (6, "http://b.example.com./english", day(25)), (6, "http://b.example.com./english", day(25)), (7, "http://a b.example.com/", day(5)), (None, "http://b.example.com/ends", day(5))],
        "page_id long, url string, fetched_at date",
    )
    e = [("ads", "b.example.com", "/", day(2), "add"), ("ads", "b.example.com", "/", day(10), "remove"), ("spam", "b.example.com", "/en/", day(20), "add"), ("spam", "b.example.com", "/en/", day(21), "add"), ("spam", "b.example.com", "/en", day(2), "add"), ("spam", "b.example.com", "/en", day(12), "remove")]
    entries = spark.createDataFrame(e, "list_name string, domain string, prefix string, at date, action string")
    got = {r["page_id"]: (r["lists"], r["n_active"]) for r in url_filters.judge_captures(pages, entries).collect()}
    assert got == {1: ("ads", 1), 2: ("", 0), 3: ("spam", 1), 4: ("", 0), 5: ("", 0), 6: ("", 0), 7: ("", 0), None: ("ads", 1)}
    assert url_filters.judge_captures(pages, entries).count() == 9
    assert url_filters.judge_captures(pages.limit(0), entries).count() == 0
    assert not any(r["blocked"] for r in url_filters.judge_captures(pages, entries.limit(0)).collect())


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = docs.cache()
        if name != "mixture":
            assert 0.5 * n < docs.count() <= n
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()


def test_pipeline_on_odd_rows(spark, corpus, empty):
    """Every stage on nulls, repeated rows and clashing names, against what the operators' brute-force tests establish, and on no rows."""
    import corpus_pipeline

    sf, rows = "/root/testdata/sf0.001", set(corpus.collect())
    docs, none = corpus, empty
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, none = stage(spark, docs, sf).cache(), stage(spark, none, sf)
        assert docs.columns == corpus.columns and set(docs.collect()) <= rows and none.count() == 0, name
        if name == "exact_dedup":
            texts = [r["text"] or "" for r in docs.collect()]
            assert len(texts) == len(set(texts))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.filter("piece = 0").count() == docs.count() and corpus_pipeline.STAGES[-1][1](spark, none, sf).count() == 0


def test_queries(spark):
    """The columns that the thin queries derive."""
    from lexforge.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op3_toxicity"](spark, sf).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)
    near = QUERIES["op5_near_dedup"](spark, sf).collect()
    assert {r["class_id"] for r in near} == {r["doc_id"] for r in near if r["kept"]} and len(near) == len(docs)
    sizes, taken, target = Counter(), Counter(), {}
    for r in QUERIES["op8_mix_sources"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").collect():
        assert r["size"] == len(WORD.findall(docs[r["doc_id"]])) and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.01 * sizes[s] + 20 for s in sizes)
    sequences = Counter()
    for r in QUERIES["op1_pack_sequences"](spark, sf).collect():
        sequences[r["sequence_id"]] += r["length"]
    assert max(sequences.values()) <= 2048 and len(sequences) <= -(-sum(sequences.values()) // 2048) + 2
    assert {512, 1024, 2048} <= {r["limit"] for r in QUERIES["op7_token_counts"](spark, sf).collect()}
