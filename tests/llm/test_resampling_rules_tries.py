"""Resampling, quality rules and conversation tries against brute force, on odd rows, and as registered queries."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import prefix_trie, quality_rules, registry, resampling

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
TABLES = ("documents", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", ["op11_target_resampling", "op12_quality_rules", "op13_conversation_prefix_trie"])
def test_registered_queries_agree_with_sql(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir)
    want = duck.execute(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    places = [[x[0] for x in want.description].index(c) for c in columns]
    assert len(places) == len(want.description)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(tuple(r[i] for i in places) for r in want.fetchall())


# -- resampling


def grams(text, n):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 97 for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute_resample(rows, target, n, seed, fewest, percent):
    found = [(i, t, *grams(t, n)) for i, t in rows]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for x in target for b in grams(x, n)[1])
    total, aim = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + 97) / ((s[b] + 1) * (aim + 97)))) for b in range(97)]
    out = []
    for i, _, words, f in found:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in out if r[4] >= fewest), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = [r[:4] for r in able[: percent * len(able) // 100]]
    return Counter(r[:4] for r in out), drawn


LINES = ["the cash flow of the year", "Net Sales were HIGH", "été à la plage 123", "x", "", "...", "one two three four five six"]


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_is_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i, "\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 9)))) for i in range(300)] + [(900, None), (901, ""), (902, "\n".join(["net sales"] * 3000))]
    target = ["net sales\nwere high", None, "", "cash flow"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), n, 97, 7, 5, 40).collect()
    every, drawn = brute_resample(rows, target, n, 7, 5, 40)
    assert Counter(tuple(r)[:4] for r in got) == every
    assert [tuple(r)[:4] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_resampling_of_odd_rows(spark, odd, none):
    target = spark.createDataFrame([("the quick fox",)], "text string")
    got = resampling.resample(odd, target, 2, 97, 7, 3, 100).collect()
    every, drawn = brute_resample([(r["doc_id"], r["text"]) for r in odd.collect()], ["the quick fox"], 2, 7, 3, 100)
    assert Counter(tuple(r)[:4] for r in got) == every
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))
    assert resampling.resample(none, target).collect() == []
    alone = resampling.resample(odd, target.limit(0), 1, 97).count()
    assert alone == odd.count()


def test_each_distinct_line_is_weighed_once(spark):
    docs = spark.createDataFrame([(i, "a common line\n" * 5 + f"line {i}") for i in range(50)], "doc_id long, text string")
    lines = resampling.distinct_lines(resampling._lines(docs), 1, 97)
    assert lines.count() == 51 and lines.agg(F.max("times")).first()[0] == 250


# -- quality rules


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_rules_are_brute_force(spark, odd):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a", "b", " ", "\n", "# ", "é<", "\t", " "]) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text"))
    got = quality_rules.judge(docs, docs.limit(0), 64)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = Counter((r["doc_id"], *brute_base(r["text"])) for r in docs.collect())
    assert Counter(tuple(r) for r in got.select("doc_id", *names).collect()) == want
    failed = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in got.collect()}
    assert failed[3] == failed[4] == failed[6] == (True, False) and failed[9] == (True, False)
    assert all(kept != bad for bad, kept in failed.values())  # nothing is trusted, so only the base rules decide


def test_poor_texts_go_and_others_stay(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(400)]
    good = [(i, " ".join(rng.choices(words, k=120))) for i in range(400)]
    poor = [(1000 + i, " ".join(w + "***" for w in rng.choices(words, k=120))) for i in range(60)]
    docs = spark.createDataFrame(good + poor, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 400, 2)] + [(None,), (2,), (77777,)], "doc_id long")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, trusted).collect()}
    assert not any(kept[i] for i, _ in poor)
    assert sum(kept[i] for i, _ in good) >= 396


def test_the_trusted_sample_is_bounded(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    assert 700 < quality_rules.trusted_rows(ids, 1000).count() < 1300
    assert quality_rules.trusted_rows(ids, 20_000).count() == 20_000


def test_rules_of_nothing(spark, none):
    assert quality_rules.judge(none, none).collect() == []


# -- tries


def brute_nodes(raw, every=20, most=4):
    talks = defaultdict(list)
    for c, turn, role, text in raw:
        if c is not None:
            talks[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    talks = {c: [x for _, x in sorted(v, key=lambda x: x[0])] for c, v in talks.items()}
    whole = {}
    for c, v in talks.items():
        h = zlib.crc32(str(c).encode()) % most
        whole[c] = tuple(talks.get(c - int(math.fmod(c, every)), [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not kids[p]
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if whole[c] == p))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def talks(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(-5, n):
        same = rng.random() < 0.3
        length = 3 if same else rng.choice([1, 2, 2, 3, 5, 9, 30])
        for d in range(length):
            said = f"hello {d}" if same or rng.random() < 0.5 else f"{rng.randint(0, 3)} words here"
            rows.append((c, None if d == 0 and c % 3 == 0 else d, rng.choice(["user", None]) if not same else "user", said if rng.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize(("keys", "shard"), [(8, 500_000), (2, 40), (1, 7), (4, 1)])
def test_tries_are_brute_force_however_they_are_split(spark, keys, shard):
    rows = talks(keys, 150)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).repartition(3)
    sequences = prefix_trie.with_shared_openings(prefix_trie.turn_sequences(table))
    got = prefix_trie.prefix_nodes(sequences, keys, shard)
    assert Counter(tuple(r) for r in got.collect()) == brute_nodes(rows)


def test_conversations_of_nobody_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    made = lambda rows: prefix_trie.prefix_nodes(prefix_trie.with_shared_openings(prefix_trie.turn_sequences(spark.createDataFrame(rows, schema)))).collect()
    assert made([]) == [] and made([(None, 1, "user", "x")]) == []
    repeated = [(40, 1, "user", "a b"), (40, 1, "user", "a b"), (40, 2, "bot", "c " * 50_000)]
    assert Counter(map(tuple, made(repeated))) == brute_nodes(repeated)


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, 1, "user", "only turn") for c in range(1, 20)]  # conversation 0 is absent, so those with h >= 1 lose their turn
    got = [tuple(r) for r in prefix_trie.prefix_nodes(prefix_trie.with_shared_openings(prefix_trie.turn_sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()]
    assert Counter(got) == brute_nodes(rows)


def test_ids_are_hashed_in_order_across_chunks(spark, monkeypatch):
    n = 3000
    named = spark.range(n).repartition(7).select(F.col("id").alias("conv_id"), F.lit(1).cast("long").alias("s1"), F.lit(2).cast("long").alias("s2"))
    (row,) = prefix_trie.ends(named).collect()
    assert (row["n_convs"], row["least"], row["ends_sha256"]) == (n, 0, hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest())


def test_the_double_array_holds_every_edge_once():
    rng = np.random.default_rng(1)
    trie = prefix_trie.DoubleArray(16)
    states, edges = np.zeros(1, np.int64), {}
    for _ in range(6):
        pairs = sorted({(int(s), int(c)) for s in states for c in rng.integers(1, 900, rng.integers(0, 40))})
        if not pairs:
            break
        s, c = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        to = trie.add(s, c)
        edges |= dict(zip(pairs, to.tolist(), strict=True))
        assert (trie.check[to] == s).all() and trie.top < 4000 + 10 * len(edges)
        states = rng.choice(to, min(len(to), 60), replace=False)
    assert len(set(edges.values())) == len(edges)
    assert all(trie.base[s] + c == t and trie.check[t] == s for (s, c), t in edges.items())
    with pytest.raises(AssertionError):
        trie.step(np.array([0]), np.array([901]))


def test_a_shard_of_one_long_conversation():
    turns = pa.array([[{"h1": i, "h2": -i, "tokens": 1} for i in range(20_000)]], pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("tokens", pa.int32())])))
    table = pa.table({"turns": turns, "n_convs": pa.array([3]), "least": pa.array([5]), "ends_sha256": pa.array(["x"])})
    nodes = prefix_trie.shard_nodes(table, 4)
    assert nodes.num_rows == 20_001
    assert max(map(len, nodes["above"].to_pylist())) == prefix_trie.NEAR - 1


def test_sums_of_conversations_that_are_longer_than_a_step(spark):
    rows = [(c, d, "user", f"turn {min(d, 90 + c)}" + " w" * (d % 3)) for c in range(6) for d in range(200 + 30 * c)]
    sequences = prefix_trie.with_shared_openings(prefix_trie.turn_sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert Counter(tuple(r) for r in prefix_trie.prefix_nodes(sequences, 3, 100).collect()) == brute_nodes(rows)


def test_all_trusted_rows_count_and_the_quantile_is_exact(spark):
    assert quality_rules.trusted_rows(spark.range(150_000).withColumnRenamed("id", "doc_id")).count() == 150_000
    rng = random.Random(8)
    for n in (1, 999, 5000):
        means = [rng.choice([rng.gauss(500, 300), -7.25, 40 + rng.random() / 10_000]) for _ in range(n)]
        rows = spark.createDataFrame([(m,) for m in means], "mean double")
        for share in (0.001, 0.3):
            assert quality_rules.least_kept(rows, share) == sorted(means)[max(1, -int(-share * n // 1)) - 1]
    assert quality_rules.least_kept(rows.limit(0), 0.001) is None


@pytest.mark.parametrize("bits", [1, 32])
def test_no_text_is_shuffled_to_find_the_trusted_ones(spark, monkeypatch, bits):
    """Exact whatever the bitmap takes for others: with one bit an id that is most of them."""
    monkeypatch.setattr(quality_rules, "BITS_AN_ID", bits)
    rows = [(i if i % 97 else None, f"text {i}") for i in range(9000)] + [(6, "again"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = spark.createDataFrame([(i,) for i in range(0, 12000, 2)], "trusted_id int")
    monkeypatch.setattr(quality_rules, "materialise", lambda df, name: df.localCheckpoint())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = quality_rules.marked(docs, fitted)
        assert sorted(got.collect(), key=str) == sorted([(i, t, i is not None and i % 2 == 0) for i, t in rows], key=str)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
