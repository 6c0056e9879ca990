"""Operators that compare texts or learn from labels, against brute force, and on odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import components, decontamination, jaccard_join, quality, registry, toxicity
from lodestrata.llm.token_counts import count_tokens, tokenizer_path

from .conftest import ODD
from .test_text_operators import brute_lines, shingles


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in closure(ids, links).items()}


def near_copies(seed, groups=12, size=8):
    r = random.Random(seed)
    common = [f"c{i}" for i in range(60)]
    rows, k = [], 0
    for g in range(groups):
        base = [f"g{g}w{r.randint(0, 400)}" for _ in range(r.choice([3, 6, 7, 9, 40, 120]))] + (common if g % 3 == 0 else [])
        for _ in range(size):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                words[r.randrange(len(words))] = f"e{r.randint(0, 10**6)}"
            if r.random() < 0.3:
                words = words[: r.randint(len(words) * 8 // 10, len(words))] or words
            rows.append((k, " ".join(words)))
            k += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, n, percent, run, listed, block", [(1, 4, 85, 32, 1 << 20, 512), (2, 5, 80, 2, 30, 512), (3, 1, 80, 3, 1000, 4), (4, 4, 85, 2, 0, 3)])
def test_join_by_brute_force(spark, monkeypatch, seed, n, percent, run, listed, block):
    """Also with limits so low that most shingles take the ways for frequent ones and large groups."""
    for name, value in (("RUN", run), ("MOST_LISTED", listed), ("BLOCK", block)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_components(df, n, percent).collect()}
    assert got == brute_components(rows, n, percent)


def test_join_of_rows_that_share_ids(spark):
    """Several texts under one doc_id keep all their links, whatever the order of the rows."""
    r = random.Random(9)
    words = lambda: [f"w{r.randint(0, 10**6)}" for _ in range(60)]
    a, c, e = words(), words(), words()
    near = lambda w: [*w[:-1], "other"]
    rows = [(7, a), (7, c), (2, near(a)), (3, near(c)), (9, e), (9, e), (10, near(e)), (4, words()), (5, near(a)), (5, near(e))]
    rows = [(i, " ".join(w)) for i, w in rows]
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        got = jaccard_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85).collect()
        assert sorted((x.doc_id, x.component_id) for x in got) == [(2, 2), (3, 2), (4, 4), (5, 2), (5, 2), (7, 2), (7, 2), (9, 2), (9, 2), (10, 2)]


def test_join_of_large_groups(spark, monkeypatch):
    """A shingle in the prefix of 600 unlike texts beside 300 near copies: linked by brute force, few pairs made."""
    made = {}
    write = jaccard_join.materialise

    def watched(df, name):
        out = write(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "materialise", watched)
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    r = random.Random(12)
    common = [f"c{i}" for i in range(10)]
    rows = [(k, " ".join([*common, *(f"w{r.randint(0, 10**6)}" for _ in range(r.randint(2, 4)))])) for k in range(600)]
    base = [f"b{i}" for i in range(80)]
    rows += [(k, " ".join([*base[: r.randint(76, 80)], f"x{r.randint(0, 10**6)}"])) for k in range(600, 900)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)
    assert made["unsure"] < 900 and made["first-links"] < 900


def test_join_on_odd_rows(odd, none):
    got = jaccard_join.linked_components(odd, 4, 85).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by[2][1] == 1 and by[3] == (0, 3) and by[4] == (0, 4) and by[6] == (0, 6) and by[5] == (1, 5) and by[None][1] is None
    assert sum(r.doc_id == 9 for r in got) == 2
    assert jaccard_join.linked_components(none, 4, 85).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    nodes = {n for e in edges for n in e}
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == closure(nodes, edges)


BENCHMARK = [
    (1, "Alice has 12 apples and gives 5 apples to Maria before she walks 3 km home from the old market."),
    (2, "Which of the following planets has the largest number of known moons in the outer system today?"),
    (3, "too short"),
    (4, None),
]


def test_decontamination(spark):
    docs = [
        (10, "Intro text. " + BENCHMARK[0][1] + " And more."),
        (11, "Bob has 70 apples and gives 9 apples to Karen before she walks 8 miles home from the old market."),
        (12, "We met. Then Bob has 70 apples and gives 9 apples to Karen before she walks 8 km home from the old market."),
        (13, "WHICH OF THE FOLLOWING PLANETS HAS THE LARGEST NUMBER OF KNOWN MOONS IN THE OUTER SYSTEM TODAY?"),
        (14, "A clean text about apples, Alice and the old market, 12 km from home."),
        (15, None),
        (16, ""),
    ]
    schema = "doc_id long, text string"
    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontamination.contaminated(spark.createDataFrame(docs, schema), bench).collect()}
    assert got == {10: [1], 11: [1], 12: [1], 13: [2]}


def test_slots_must_be_consistent(spark):
    item = "In the morning Tom puts 4 coins in a jar and later Tom takes 4 coins from the same jar again"
    same = item.replace("Tom", "Ann").replace("4", "9")
    mixed = "In the morning Ann puts 9 coins in a jar and later Bob takes 7 coins from the same jar again"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")
    assert [r.doc_id for r in decontamination.contaminated(docs, bench).collect()] == [1]


def test_decontamination_in_blocks_and_on_odd_rows(spark, odd, none, monkeypatch):
    bench = spark.createDataFrame([(i, t) for i, t in ODD], "item_id long, text string")
    whole = {tuple(r) for r in decontamination.find_leaks(odd, bench).collect()}
    assert {(1, 1), (1, 2), (2, 1)} <= {(d, i) for d, i, _ in whole}
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 10)
    assert {tuple(r) for r in decontamination.find_leaks(odd, bench).collect()} == whole
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(odd, bench.limit(0)).count() == 0


def brute_leaks(docs, items):
    """By regular expressions on ASCII texts: items are in a text where consistent windows cover half of theirs; items of
    few words where they stand whole between ends of sentences."""

    def words(text):
        found = []
        for m in re.finditer(r"(?:[A-Za-z0-9]|(?<=\d)[.,](?=\d))+", text or ""):
            w, before = m[0], (text[found[-1][3] : m.start()] if found else ".")
            opens = not found or bool(re.search(r"[\n!.:?]", before))
            kind = "#" if w[0].isdigit() and w[-1].isdigit() else "u" if found and found[-1][0] == "#" and w.lower() in decontamination.UNITS and not opens else "N" if w[0].isupper() and not opens else ""
            found.append((kind, w.lower(), m.start(), m.end(), opens))
        return found

    def windows(ws, plain):
        n = decontamination.WORDS
        every = {k: ws[k : k + n] for k in range(len(ws) - n + 1)}
        if plain:
            return {k: tuple(w[1] for w in x) for k, x in every.items()}
        return {k: tuple(w[0] or w[1] for w in x) for k, x in every.items() if sum(not w[0] for w in x) >= decontamination.LITERALS}

    out = set()
    for d, text in docs:
        ws = words(text)
        for i, item in items:
            vs = words(item)
            n = len(vs)
            if 0 < n < decontamination.WORDS:
                opens = [w[4] for w in ws] + [True]
                if any(opens[f] and opens[f + n] and [w[1] for w in ws[f : f + n]] == [w[1] for w in vs] for f in range(len(ws) - n + 1)):
                    out.add((d, i))
                continue
            for plain in (False, True):
                theirs, ours = windows(vs, plain), windows(ws, plain)
                lined = {}
                for p, x in theirs.items():
                    for f, y in ours.items():
                        if x == y:
                            lined.setdefault(f - p, []).append((p, f))
                covered = set()
                for met in lined.values():
                    stands = {}
                    for p, f in met:
                        for k in range(0 if plain else decontamination.WORDS):
                            if vs[p + k][0]:
                                stands.setdefault(vs[p + k][1], set()).add(ws[f + k][1])
                    if all(len(v) == 1 for v in stands.values()):
                        covered |= {p for p, _ in met}
                if theirs and len(covered) >= decontamination.SHARE * len(theirs):
                    out.add((d, i))
    return out


def test_decontamination_by_brute_force(spark):
    r = random.Random(21)
    names, plain = ["Ann", "Bob", "Karen", "Tom"], "gives takes apples coins from the old market to his jar and walks home again later in spring".split()

    def sentence(n):
        out = []
        for _ in range(n):
            out.append(r.choice(names) if r.random() < 0.12 else f"{r.randint(2, 99)} {r.choice(['km', 'apples', 'days'])}" if r.random() < 0.15 else r.choice(plain))
        return " ".join(out)

    items = [(i, ". ".join(sentence(r.randint(4, 9)) for _ in range(r.randint(1, 3)))) for i in range(25)] + [(100, "two words"), (101, "Yes"), (102, ""), (103, None), (104, "!!")]
    docs = [(500, "Two words."), (501, "yes"), (502, "There are two words here and more to read, yes"), (503, ""), (504, None)]
    for d in range(60):
        _, item = r.choice(items[:25])
        changed = re.sub(r"\d+", lambda m: str(r.randint(2, 99)) if r.random() < 0.5 else m[0], item)
        if r.random() < 0.5:
            changed = changed.replace("Ann", "Eve").replace("Tom", "Kim")
        docs.append((d, f"{sentence(r.randint(0, 12))}. {changed[: r.randint(len(changed) // 3, len(changed))]}. {sentence(r.randint(0, 9))}"))
    wide = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, share string")
    got = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(wide, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_leaks(docs, items) and (500, 100) in got and (501, 101) in got and len(got) > 20


def test_index_finds_the_nearest_exactly(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    r = np.random.default_rng(2)
    vocabulary = [(t, level, float(r.integers(3, 40))) for t in range(100, 130) for level in (1, 2)]
    ids, labels = np.arange(60), r.integers(0, 2, 60)
    keys = np.unique(r.integers(0, 60, 400) * 30 + r.integers(0, 30, 400))
    rows, terms, tf = keys // 30, (keys % 30 + 100).astype(np.uint64), r.integers(1, 4, len(keys))
    index = toxicity.Index(vocabulary, ids, labels, rows, terms, tf, {0: 5.0, 1: 1.0})
    dense = np.zeros((len(index.ids), index.size))
    for c in range(index.size):
        for b in range(index.blocks):
            i, j = index.cuts[c * (index.blocks + 1) + b : c * (index.blocks + 1) + b + 2]
            dense[index.where[i:j], c] = index.value[i:j]
    assert np.allclose((dense**2).sum(axis=1), 1)
    for _ in range(50):
        columns = np.sort(r.choice(index.size, r.integers(1, 8), replace=False))
        value = index.query(columns)
        found, cosines = index.nearest(columns, value, 7)
        want = dense[:, columns] @ value
        order = [i for i in np.lexsort((np.arange(len(want)), -np.round(want, 12))) if want[i] > 0][:7]
        assert np.allclose(cosines, want[order])


def corpus(n, seed):
    r = random.Random(seed)
    bad = ["idiotic", "scumbag", "moronic"]
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.2
        words = [f"w{r.randint(0, 300)}" for _ in range(r.randint(20, 60))]
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), 1))
    return rows, labels


def test_toxicity_learns_outside_the_fold(spark, odd, none):
    rows, labels = corpus(400, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    index = toxicity.learn(docs, marks)
    got = {r.doc_id: r for r in toxicity.score_texts(docs, index).collect()}
    truth = {i: y for i, y, _ in labels}
    fold = [i for i in got if got[i].held_out]
    assert 50 < len(fold) < 150 and all(got[i].predicted == truth[i] for i in fold)
    assert not set(fold) & set(index.ids.tolist())
    assert all(0 <= r.score <= 1 for r in got.values()) and max(len(r.neighbours) for r in got.values()) == toxicity.NEIGHBOURS
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_texts(docs, toxicity.learn(docs, flipped)).collect()}
    assert all(again[i] == pytest.approx(got[i].score, abs=1e-12) for i in got)
    odd_scores = toxicity.score_texts(odd, index).collect()
    assert len(odd_scores) == len(ODD) and all(0 <= r.score <= 1 for r in odd_scores) and toxicity.score_texts(none, index).count() == 0


def test_toxicity_by_brute_force(spark):
    """Neighbours and cosines of whole texts, from weights that are computed term by term."""
    import math

    rows, labels = corpus(60, 8)
    rows += [(100, "idiotic idiotic idiotic w1 w2"), (101, "w3"), (102, ""), (103, None), (104, "w1 " * 40)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    index = toxicity.learn(docs.repartition(3), marks)
    held = {i: Counter(np.concatenate([t for _, _, t, _ in toxicity.word_terms(pa.array([text], pa.string()))]).tolist()) for i, text in rows}
    leveled = {i: {(t, level) for t, n in c.items() for level in toxicity.LEVELS.tolist() if level <= n} for i, c in held.items()}
    mark = {i: y for i, y, _ in labels if i in set(index.ids.tolist())}
    df, in_examples, in_toxic = (Counter(x for i in ids for x in leveled[i]) for ids in (leveled, mark, [i for i, y in mark.items() if y]))
    toxic, total = sum(mark.values()), len(mark)

    def weight(x):
        k1, k = in_toxic[x], in_examples[x]
        part = lambda n, row, column: n * math.log(n * total / (row * column)) if n else 0.0
        clean = total - toxic
        ratio = 2 * (part(k1, k, toxic) + part(k - k1, k, clean) + part(toxic - k1, total - k, toxic) + part(clean - k + k1, total - k, clean))
        square = (1 + max(ratio, 0)) ** 2
        return square / (square + toxicity.CLEAR_EVIDENCE**2) * (math.log((1 + len(rows)) / (1 + df[x])) + 1e-9)

    weights = {x: weight(x) for x in in_examples}
    size = lambda i: math.sqrt(sum(weights[x] ** 2 for x in leveled[i] if x in weights))
    cosine = lambda i, j: sum(weights[x] ** 2 for x in leveled[i] & leveled[j] if x in weights) / (size(i) * size(j)) if size(i) and size(j) else 0.0
    for r in toxicity.score_texts(docs, index).collect():
        want = sorted(((cosine(r.doc_id, j), j) for j in mark), reverse=True)
        want = [c for c, _ in want if c > 1e-9][: toxicity.NEIGHBOURS]
        assert r.similarities == pytest.approx(want, abs=2e-5), r.doc_id
        assert all(cosine(r.doc_id, j) == pytest.approx(c, abs=2e-5) for j, c in zip(r.neighbours, r.similarities, strict=True))


def test_toxicity_with_contradictory_labels(spark):
    rows, labels = corpus(80, 3)
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, predicted string, score double")
    twice = spark.createDataFrame([*labels, *((i, 0, 1) for i, _, _ in labels), (None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")
    once = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score_texts(docs, toxicity.learn(docs, x)).collect()) for x in (twice, once))
    assert a == b


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_toxicity_on_the_held_out_fold(spark, scale):
    """With 14 and with 120 toxic texts in the fold."""
    docs, marks = (spark.read.parquet(f"/root/testdata/{scale}/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.learn(docs, marks)
    fold = marks.where(toxicity.held_out()).select("doc_id", "toxic")
    got = Counter((r.toxic, r.predicted) for r in toxicity.score_texts(docs.join(fold, "doc_id", "left_semi"), index).join(fold, "doc_id").collect())
    assert got[1, 1] >= 0.9 * (got[1, 0] + got[1, 1]) and got[0, 1] <= max(1, 0.01 * (got[0, 0] + got[0, 1]))


def test_toxicity_finds_texts_of_a_rare_topic(spark):
    """Their words stand in too few examples to be clear evidence by themselves, and beside other examples'."""
    r = random.Random(11)
    rows, labels = corpus(400, 4)
    for i in range(1000, 1040):
        words = [f"{a}{b}" for a in ("schurke", "trottel", "lump") for b in "xyz"] if i % 3 == 0 else [f"wetter{c}" for c in "abcdefghi"]
        rows.append((i, " ".join(r.sample(words, 5))))
        labels.append((i, int(i % 3 == 0), 1))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    index = toxicity.learn(docs, marks)
    got = {x.doc_id: x for x in toxicity.score_texts(docs, index).where("doc_id >= 1000").collect()}
    fold = [i for i in got if got[i].held_out]
    assert any(i % 3 == 0 for i in fold) and all(got[i].neighbours for i in got)
    assert all(got[i].predicted == int(i % 3 == 0) for i in fold)


def test_toxicity_counts_documents_and_every_repetition(spark):
    """A term's frequency is that of all documents, and nothing ends at four times."""
    docs = spark.createDataFrame([(i, "foul " * 9 if i == 1 else "foul" if i == 2 else "fair") for i in range(50)] + [(100, None), (101, "")], "doc_id long, text string")
    known = toxicity.Terms(np.unique(np.concatenate([t for _, _, t, _ in toxicity.word_terms(pa.array(["foul fair"]))])), np.array([6, 6]))
    counted, texts = toxicity.document_frequencies(docs.repartition(3), known)
    assert texts == 52 and sorted(counted.reshape(2, 6).tolist()) == [[2, 1, 1, 1, 1, 0], [48, 0, 0, 0, 0, 0]]


def test_toxicity_without_labels(spark, odd):
    index = toxicity.learn(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score_texts(odd, index).collect()} == {0.0}


def test_quality_grades_are_ordered(spark, odd, none):
    r = random.Random(6)
    rows, grades = [], []
    for i in range(300):
        g = r.randint(0, 2)
        words = [f"word{r.randint(0, 200)}" + ("###" if r.random() < (0.9, 0.4, 0.0)[g] else "") for _ in range(40)]
        rows.append((i, " ".join(words)))
        grades.append((i, g))
    docs, rated = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(grades, "doc_id long, grade int")
    model = quality.learn(docs, rated, 3)
    assert np.diff(model.thresholds()).min() > 0
    got = {x.doc_id: x for x in quality.grade_texts(docs, model).collect()}
    held = {x.doc_id for x in docs.where(toxicity.held_out()).collect()}
    mean = lambda g: np.mean([got[i].expected_grade for i, k in grades if k == g and i in held])
    assert mean(0) + 0.4 < mean(1) < mean(2) - 0.3
    right = Counter(got[i].selected == (g >= 1) for i, g in grades if i in held)
    assert right[True] / sum(right.values()) > 0.9
    for x in got.values():
        assert x.tail_probability >= x.expected_grade - 1 - 1e-9
    odd_rows = quality.grade_texts(odd, model).collect()
    assert len(odd_rows) == len(ODD) and not any(x.selected for x in odd_rows if x.doc_id in (3, 4, 6)) and quality.grade_texts(none, model).count() == 0


def test_quality_likelihood_by_brute_force(spark):
    """Probabilities are those of the model's formula, and the fit is at a maximum of the penalised likelihood."""
    import math

    r = np.random.default_rng(5)
    n, width = 200, 12
    x = r.random((n, width)) < 0.4
    truth = r.normal(0, 2, width)
    score = x @ truth + r.logistic(size=n)
    grade = np.digitize(score, np.quantile(score, [0.3, 0.7]))
    rows, places = np.nonzero(x)
    model = quality.Ordinal(3).fit(rows, places, np.ones(len(rows)), grade)

    def loss(weights, cuts):
        total = 0.0
        for i in range(n):
            s = sum(weights[p] for p in np.flatnonzero(x[i]))
            below = [0.0, *(1 / (1 + math.exp(-(c - s))) for c in cuts), 1.0]
            total -= math.log(below[grade[i] + 1] - below[grade[i]]) / n
        return total + quality.PENALTY / 2 * float((weights**2).sum())

    best = loss(model.weights[:width], model.thresholds())
    for k in range(width):
        for d in (-0.1, 0.1):
            w = model.weights[:width].copy()
            w[k] += d
            assert loss(w, model.thresholds()) > best - 1e-4
    for k in range(2):
        for d in (-0.1, 0.1):
            cuts = model.thresholds().copy()
            cuts[k] += d
            assert loss(model.weights[:width], cuts) > best - 1e-4
    tails = model.tails(np.array([0.3]))[0]
    assert tails == pytest.approx([1 - 1 / (1 + math.exp(-(c - 0.3))) for c in model.thresholds()])


def test_quality_without_grades(spark):
    """Null grades are not learned from, the least of contradictory ones is; tables without any give a model."""
    labels = spark.createDataFrame([(1, None, None), (2, 0, None), (3, 1, None), (4, None, 1), (5, 1, 0), (6, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in registry.grades_of(labels).collect()} == {1: None, 2: 0, 3: None, 4: None, 5: 2, 6: 1, None: 2}
    docs = spark.createDataFrame([(i, f"word{i} and more", 3.0) for i in range(40)], "doc_id long, text string, expected_grade double")
    twice = spark.createDataFrame([(i, g) for i in range(40) for g in ((i % 3), 2)], "doc_id long, grade int")
    least = spark.createDataFrame([(i, i % 3) for i in range(40)], "doc_id long, grade int")
    assert (quality.learn(docs, twice, 3).weights == quality.learn(docs, least, 3).weights).all()
    none = quality.learn(docs, twice.where("false"), 3)
    assert quality.grade_texts(docs, none).count() == 40


def test_registry_names():
    names = list(registry.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14)) and set(registry.oracle_sql()) <= set(names)


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd_rows = spark.createDataFrame([(10_000 + k if i is not None else None, t, "en", None, 0) for k, (i, t) in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long")
    now = docs.unionByName(odd_rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf_dir)
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if k < 4:
            assert after.columns == docs.columns
            assert after.join(now, "doc_id", "left_anti").where("doc_id is not null").count() == 0
        if name == "toxicity":
            index = toxicity.learn(now, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            bad = {r.doc_id for r in toxicity.score_texts(now, index).where("predicted = 1").collect()}
            assert sorted(r.doc_id for r in after.where("doc_id is not null").collect()) == sorted(r.doc_id for r in now.where("doc_id is not null").collect() if r.doc_id not in bad)
        if name == "line_dedup":
            want = brute_lines([(r.doc_id, r.text) for r in now.collect() if r.doc_id is not None and r.text is not None])
            assert {r.doc_id: r.text for r in after.collect() if r.doc_id is not None and r.text is not None} == want
            assert all(r.n_chars == len(r.text or "") for r in after.collect())
        if name == "decontamination":
            bad = {r.doc_id for r in decontamination.find_leaks(now, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()} - {None}
            assert bad and sorted(r.doc_id for r in after.collect() if r.doc_id is not None) == sorted(r.doc_id for r in now.collect() if r.doc_id is not None and r.doc_id not in bad)
        if name == "packing":
            sums = {r.sequence_id: r.n for r in after.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}
            lengths = {r.doc_id: r.n for r in after.where("doc_id is not null").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
            counted = {r.doc_id: r.n_tokens + 1 for r in count_tokens(now.select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json")).collect() if r.doc_id is not None}
            assert max(sums.values()) <= 2048 and len(sums) <= -(-sum(sums.values()) // 2048) + 1 and lengths == counted
        if name == "ngram_jaccard_join":
            rows = [(r.doc_id, r.text) for r in now.collect()]
            keep = {i for i, (_, c) in brute_components(rows, 5, 80).items() if i == c}
            assert {r.doc_id for r in after.collect() if r.doc_id is not None} == keep
        now = after
    assert now.select("doc_id").distinct().count() > 100
