"""Operators on single texts against brute force, and on odd rows."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import fingerprints, html_extraction, line_dedup, packing, substring_dedup, words
from lodestrata.llm.token_counts import Encoder, count_tokens, tokenizer_path

from .conftest import ODD

BPE = tokenizer_path("byte_bpe_50k.json")


def shingles(text, n):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1))} if found else set()


@pytest.mark.parametrize("n", [1, 4, 5])
@pytest.mark.parametrize("piece", [40, 1 << 22])
def test_shingle_sets(monkeypatch, n, piece):
    monkeypatch.setattr(words, "PIECE_BYTES", piece)
    texts = [t for _, t in ODD] + ["A b C d e F"]
    assert [len(s) for s in words.shingle_sets(pa.array(texts), n)] == [len(shingles(t, n)) for t in texts]


def random_texts(n, seed=1):
    r = random.Random(seed)
    letters = [*"ab1'. \n\t,éß", " ", " ", "<|endoftext|>", "\xa0", "　", "語", "'s"]
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    texts = random_texts(3000) + [t for _, t in ODD]
    want = [e.ids for e in Tokenizer.from_file(BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids.tolist() for e in Encoder(BPE).batches(pa.array(texts)) for ids in e.ids()] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    texts = random_texts(50)
    got = [ids.tolist() for e in Encoder(tokenizer_path(name)).batches(pa.array(texts)) for ids in e.ids()]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        want = [e.ids for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)]
    else:
        import sentencepiece

        want = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name)).encode(texts)
    assert got == want
    with pytest.raises(ValueError):
        Encoder("x.bin")


def test_token_counts_on_odd_rows(odd, none):
    got = count_tokens(odd, BPE)
    assert got.columns == ["doc_id", "score", "n_bytes", "n_tokens", "over_limit"]
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(ODD) and (rows[3].n_bytes, rows[3].n_tokens, rows[4].n_tokens) == (0, 0, 0)
    assert rows[9].over_limit and rows[10].n_bytes == len(dict((i, t) for i, t in ODD)[10].encode())
    assert count_tokens(none, BPE).count() == 0


def test_fingerprints_estimate(spark):
    r = random.Random(3)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(3000)]
    other = base[:1500] + [f"v{i}" for i in range(1500)]
    texts = [" ".join(base), " ".join(other), " ".join(base[:1000])]
    a, b, c = (s[: fingerprints.SKETCH_SIZE] for s in words.shingle_sets(pa.array(texts), 5))
    x, y, z = (shingles(t, 5) for t in texts)
    assert abs(fingerprints.resemblance(a, b) - len(x & y) / len(x | y)) < 0.1
    assert abs(fingerprints.containment(c, a) - 1) < 0.15 and abs(fingerprints.distinct_count(a) / len(x) - 1) < 0.2
    assert (fingerprints.from_text(fingerprints.to_text(a)) == a).all()
    whole = words.shingle_sets(pa.array([texts[0]]), 5)[0]
    assert (fingerprints.merge(whole[::2][:256], whole[1::2][:256]) == whole[:256]).all()


def test_fingerprints_of_successors(odd, none):
    rows = [(i, t or "") for i, t in ODD]
    ids = sorted({i for i, _ in rows if i is not None}, reverse=True)
    got = fingerprints.compare_with_next(odd).collect()
    assert len(got) == len(ODD) and fingerprints.compare_with_next(none).count() == 0
    text = dict(rows)
    for r in got:
        if r.doc_id in (8, 7, 6, 5, 4, 3, 2):
            own, after = text[r.doc_id], text[ids[ids.index(r.doc_id) + 1]]
            edited = own[: len(own) - len(own) // 3] + after[: len(own) // 3]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(own)
            a, b = shingles(own, 5), shingles(after, 5)
            assert r.near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1


def test_fingerprints_merge_by_group(spark, odd):
    sketched = fingerprints.add_fingerprints(odd.select("doc_id", "text")).withColumn("g", F.lit(1))
    merged = fingerprints.from_text(fingerprints.merge_fingerprints(sketched, "g").first().fingerprint)
    every = np.unique(np.concatenate(words.shingle_sets(pa.array([t for _, t in ODD]), 5)))
    assert (merged == every[: fingerprints.SKETCH_SIZE]).all()


def test_packing_is_gapless_and_tight(spark, odd, none):
    packed = packing.pack(odd, BPE, capacity=64, keep_ids=True)
    rows = packed.collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in rows)
    want = sum(len(ids) + 1 for e in Encoder(BPE).batches(pa.array([t for _, t in ODD])) for ids in e.ids())
    assert total == want and len(by) <= -(-total // 64) + 1
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 11)
    assert [x[2] for x in long[1:]] == [64] * (len(long) - 1) and all(a[1] + a[2] == b[1] for a, b in zip(long[:-1], long[1:], strict=True))
    assert sum(len(r.ids) for r in packing.sequences(packed).collect()) == total
    assert packing.pack(none, BPE).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plan_places_every_rank_once(seed):
    r = random.Random(seed)
    counts = {length: r.randint(1, 30) for length in r.sample(range(1, 101), 20)}
    slots, used = set(), {}
    for length, first, ranks, each, sequence, base in packing.plan_best_fit(counts, 100):
        for k in range(ranks):
            slots.add((length, first + k))
            s, o = sequence + k // each, base + k % each * length
            cells = used.setdefault(s, set())
            span = set(range(o, o + length))
            assert not cells & span and o + length <= 100
            cells |= span
    assert slots == {(length, k) for length, n in counts.items() for k in range(n)}
    room: list[int] = []  # best-fit decreasing, piece by piece
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, left in enumerate(room) if left >= length]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= length
        else:
            room.append(100 - length)
    assert len(used) == len(room) and all(cells == set(range(len(cells))) for cells in used.values())


def brute_lines(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = t.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(x.strip(" ") for x in lines[k : k + 3])
            if "".join(w):
                if w in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(w)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_by_brute_force(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice(["a", "b", " c", "", "d"]) for _ in range(r.randint(1, 12)))) for i in range(60)]
    got = {x.doc_id: x.text for x in line_dedup.drop_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_on_odd_rows(odd, none):
    got = line_dedup.drop_repeated_windows(odd).collect()
    text = {r.doc_id: r.text for r in got}
    assert len(got) == len(ODD) and text[3] is None and text[8] == "x\ny" and text[7].startswith("line a")
    assert line_dedup.drop_repeated_windows(none).count() == 0


def brute_substrings(texts, size=200):
    seen: dict = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - size + 1):
            seen.setdefault(t[i : i + size], []).append((d, i))
    cover = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                cover[d][i : i + size] = b"\x01" * size
    return cover


@pytest.mark.parametrize("hot, flush", [(2000, 500_000), (0, 500_000), (1, 40)])
def test_substring_dedup_by_brute_force(spark, monkeypatch, hot, flush):
    """Also with limits so low that all anchors count as hot, and blocks go out early."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "FLUSH", flush)
    r = random.Random(7)
    parts = ["".join(r.choice("abc é") for _ in range(r.choice([50, 150, 199, 200, 201, 330]))) for _ in range(12)]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 5))) for _ in range(40)] + ["ab" * 300, "ab" * 99 + "a", None, "", "x" * 200, "x" * 201]
    raw = [(t or "").encode() for t in texts]
    cover = brute_substrings(raw)
    got = {x.doc_id: x for x in substring_dedup.drop_repeated_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    for d, (t, c) in enumerate(zip(raw, cover, strict=True)):
        kept = bytes(b for b, x in zip(t, c, strict=True) if not x)
        spans = len(re.findall(b"\x01+", bytes(c)))
        assert (bytes(got[d].kept), got[d].n_removed, got[d].n_spans) == (kept, sum(c), spans), d


def test_substring_dedup_on_odd_rows(odd, none):
    got = substring_dedup.drop_repeated_substrings(odd).collect()
    assert len(got) == len(ODD) and {r.n_removed for r in got if r.doc_id == 9} == {8999 + 1}
    assert {r.n_removed for r in got if r.doc_id in (3, 4, 5, 1, 2)} == {0}
    assert substring_dedup.drop_repeated_substrings(none).count() == 0


PAGE = (
    "<body><header><h1>Site</h1><a href=x>home</a></header><div class='cookie-notice'>We use cookies. Accept them now, please, it is good for you.</div><div id=content><h2>Title &amp; more</h2>"
    "<p>First paragraph is long enough to be content, and has commas, stops and so on.<script>var t='</p>';</script> It goes on.<p>Short.<ul><li>point  a<li>point&nbsp;b</ul></div>"
    "<aside>Related: <a href=q>other</a></aside><div class=comments><p>Great post, thanks a lot for this, really. I loved it!</p></div><form><label>Mail</label></form><footer>(c) 2020</footer>"
)


def test_html_extraction(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<p>unclosed <b>text, with some words, and more"), (5, "plain text, no tags at all, but a sentence."), (6, "<div style='display:none'>hidden text, of some length, here.</div>")]
    got = {r.page_id: r.text for r in html_extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[1] == "Title & more\nFirst paragraph is long enough to be content, and has commas, stops and so on. It goes on.\nShort.\npoint a\npoint b"
    assert (got[2], got[3], got[6]) == ("", "", "") and got[4] == "unclosed text, with some words, and more" and got[5].startswith("plain text")


@pytest.mark.parametrize("seed", range(40))
def test_minimum_cut_by_brute_force(seed):
    r = random.Random(seed)
    n = r.randint(1, 9)
    costs = [r.uniform(-2, 2) for _ in range(n)]
    edges = {(i, j): r.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5}

    def energy(labels):
        return sum(max(0, -c) if x else max(0, c) for c, x in zip(costs, labels, strict=True)) + sum(w for (i, j), w in edges.items() if labels[i] != labels[j])

    best = min(energy([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
    assert energy(html_extraction.minimum_cut(costs, edges)) == pytest.approx(best)


def test_html_extraction_keeps_what_follows():
    body = "<p>This sentence follows, and it is long enough to be content by itself.</p>"
    for before in ('<svg class="i"/>', "<math/>", "<svg-icon>", "<title-bar></title-bar>", "<select-menu>", "<div><select><option>a</div>", "<div><object data=x></div>", "<svg><path d=x /></svg>"):
        assert "This sentence follows" in html_extraction.main_text(f"<article><p>before</p>{before}{body}</article>"), before
    assert "hidden" not in html_extraction.main_text(f"<article>{body}<select><option>hidden</option></select><svg><text>hidden</text></svg></article>")
    for page in ("<p>Where a < b the claim holds, as is well known. More text", "Where a < b the claim holds, as is well known. More text"):
        assert html_extraction.main_text(page).endswith("a < b the claim holds, as is well known. More text")
    assert html_extraction.main_text("<p>The text is here, and it is content in full. <a href=") == "The text is here, and it is content in full."


PROSE = " ".join(f"This is sentence number {i} of a long piece of prose, with words." for i in range(10))


@pytest.mark.parametrize("name", ["post-login", "search-results", "article-header"])
def test_prose_outweighs_an_unlucky_class(name):
    page = f"<body><nav><a href=x>Home</a></nav><div class='{name}'><h1>The title</h1><p>{PROSE}</p><p>{PROSE}</p></div><footer>(c) x</footer></body>"
    assert html_extraction.main_text(page).endswith(f"{PROSE}\n{PROSE}")
    assert html_extraction.main_text(f"<body><div class='{name}'>Your mail</div><article><p>{PROSE}</p></article></body>") == PROSE


@pytest.mark.parametrize("unit", ['<a "', '<a href="x', '<a ">" ', "<p don't ", "<!", "<!--", "<div><li>", "</dd><li><p>", "<svg><g>", "<script>x", "a < b "])
def test_broken_pages_take_time_in_proportion(unit):
    began = time.process_time()
    html_extraction.main_text(unit * ((1 << 20) // len(unit)))
    assert time.process_time() - began < 20


def test_long_pages():
    began = time.process_time()
    n = 10_000
    labels = html_extraction.minimum_cut([(-1) ** i * 1.0 for i in range(n)], {(i, i + 1): 1.2 for i in range(n - 1)})
    assert len(labels) == n
    text = html_extraction.main_text("<article>" + f"<p>{PROSE}</p>" * 3000 + "</article><footer>end</footer>")
    assert text.count("\n") == 2999 and time.process_time() - began < 20


def test_html_extraction_of_rows_with_clashing_columns(spark):
    rows = [(1, "u", PAGE, "old", 7, "x"), (1, "u", PAGE, None, None, None), (None, None, None, "old", 1, "y")]
    got = html_extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, score string"))
    assert got.columns == ["page_id", "url", "score", "text", "n_chars"]
    found = got.collect()
    assert len(found) == 3 and all(r.n_chars == len(r.text) for r in found) and len({r.text for r in found}) == 2


def test_line_dedup_of_a_text_of_many_lines(spark):
    began = time.time()
    lines = [f"line {i}" for i in range(200_000)]
    lines[150_000:150_003] = ["a b", "c d", "e f"]
    df = spark.createDataFrame([(1, "a b\nc d\ne f"), (2, "\n".join(lines))], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.drop_repeated_windows(df).collect()}
    assert got[2].text == "\n".join(lines[:150_000] + lines[150_003:]) and (got[2].n_lines, got[2].n_removed) == (200_000, 3)
    assert time.time() - began < 60


def test_line_dedup_agrees_with_its_sql(spark, sf_dir):
    import duckdb

    from lodestrata.llm import registry

    got = registry.op8_line_dedup(spark, sf_dir).toPandas()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = c.execute(registry.oracle_sql()["op8_line_dedup"]).df()
    columns = sorted(want.columns)
    plain = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert plain(got).equals(plain(want))


def test_successors_by_brute_force(spark):
    """All columns for all rows, with the wrap-around; also for rows that share an id or have none."""
    r = random.Random(17)
    rows = [(i, " ".join(f"w{r.randint(0, 40)}" for _ in range(r.randint(0, 90)))) for i in r.sample(range(1000), 60)]
    rows[5] = (rows[5][0], None)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(4)
    got = {x.doc_id: x for x in fingerprints.compare_with_next(df).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for (i, own), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        edited = own[: len(own) - len(own) // 3] + after[: len(own) // 3]
        a, b, e = (shingles(t, 5) for t in (own, after, edited))
        alike = lambda x, y: len(x & y) / len(x | y) if x or y else 1.0
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(own)
        assert got[i].near_next == pytest.approx(alike(a, b)) and got[i].near_edited == pytest.approx(alike(a, e))
    odd = spark.createDataFrame([(1, "a b"), (1, "c d"), (None, "e f"), (None, "g h"), (2, None), (2, None)], "doc_id long, text string")
    assert fingerprints.compare_with_next(odd).count() == 6


def test_substring_dedup_of_rows_that_share_ids(spark):
    r = random.Random(3)
    part = "".join(r.choice("abcdefgh ") for _ in range(260))
    texts = [(1, f"x{part}y"), (1, f"other {part} end"), (None, part), (None, "short"), (2, f"q{part[:199]}"), (2, f"q{part[:199]}"), (3, f"z{part[:199]}")]
    df = spark.createDataFrame([(i, t, b"k", 5) for i, t in texts], "doc_id long, text string, kept binary, n_bytes int").repartition(3)
    got = sorted((x.doc_id or 0, x.n_bytes, x.n_removed) for x in substring_dedup.drop_repeated_substrings(df).collect())
    assert got == [(0, 5, 0), (0, 260, 260), (1, 262, 260), (1, 270, 260), (2, 200, 200), (2, 200, 200), (3, 200, 0)]


PARAGRAPHS = [f"This is paragraph {i} of the article, and it has prose, with commas; it goes on for a while so that it looks like text. It ends here." for i in range(4)]
ARTICLE = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
REPLY = "<div class='u'><span>Ann {i} says 12:0{i}</span><p>I think that this is a very good article, and I want to say so, at length. Really!</p></div>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="has-sidebar nav-open"><div>{ARTICLE}</div></body>',
        f'<body class="post-template has-sidebar nav-open cookie-ok"><article>{ARTICLE}</article></body>',
        f'<body><form id="aspnetForm"><div>{ARTICLE}</div></form></body>',
        f'<div class="comments-enabled post">{ARTICLE}</div>',
        f'<div class="shareholders-report social-policy">{ARTICLE}</div>',
        f'<main><section class="legal-news alert-page">{ARTICLE}</section></main>',
        f'<article>{ARTICLE}</article><div class="user-talk"><h3>12 Responses</h3>{"".join(REPLY.format(i=i) for i in range(4))}</div>',
        f'<article>{ARTICLE}</article><div class="talk">{"".join(REPLY.format(i=i) for i in range(3))}</div>',
        f'<div class="has-sidebar"><article>{ARTICLE}</article><div class="comments">{"".join(REPLY.format(i=i) for i in range(30))}</div></div>',
        f'<form><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav><div>{ARTICLE}</div><footer>Copyright 2024. All rights reserved.</footer></form>',
    ],
)
def test_articles_survive_names_and_replies_go(page):
    assert html_extraction.main_text(page) == "\n".join(PARAGRAPHS)


def test_repeated_sections_are_no_replies_and_short_pages_stay():
    page = "<article>" + "".join(f'<div class="s"><h2>Part {i}</h2>{ARTICLE}</div>' for i in range(3)) + "</article>"
    assert html_extraction.main_text(page).count("paragraph") == 12 and "Part 2" in html_extraction.main_text(page)
    assert html_extraction.main_text("just a short line") == "just a short line"
    assert html_extraction.main_text("<nav><a href='/'>Home</a></nav>") == ""


def test_deep_suspicious_pages_take_linear_time():
    began = time.process_time()
    html_extraction.main_text("<div>" * 16_000 + "x" + "<form class=comments>" * 8_000 + ARTICLE)
    assert time.process_time() - began < 5
