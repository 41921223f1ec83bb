"""Operators with an exact definition against brute force on small tables."""

import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skeinwork.functions.fold import alnum
from skeinwork.llm import boilerplate_lines, leakage, repetition, survivors, tokenise

DOCS = "doc_id long, text string, ids array<int>, k long, doc string, item_id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, [1], 7, "clash", 3) for i, t in rows], DOCS)


# Problem 7 ------------------------------------------------------------------------------------------------------------

TEXTS = ["", None, " ", "Hello, world!  \n\n It's 2024's 12,345th test… 新能源汽车 電池", "a" * 700, "!" * 500, " \t " * 300, "don't " * 200, "新能源" * 300, "x1y2 " * 150, "<|endoftext|> x", "é" * 400, "​﻿" * 60, "👩‍👩‍👧 " * 80, "ab'll've " * 90]


@pytest.fixture(scope="module")
def whole():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids if x else []


@pytest.mark.parametrize("chunk, overlap", [(tokenise.CHUNK, tokenise.OVERLAP), (100, 20), (37, 9), (16, 1)])
def test_chunked_encoding_equals_whole(spark, whole, chunk, overlap):
    rng = random.Random(chunk)
    texts = TEXTS + ["".join(rng.choice("ab 'st1,新\n ") for _ in range(600)) for _ in range(20)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, "another text " * 40), (None, "no id " * 60)]
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in tokenise.encode_corpus(docs(spark, rows), chunk=chunk, overlap=overlap).collect())
    assert got == Counter((i, tuple(whole(t))) for i, t in rows)


def test_round_trip_and_empty_table(spark):
    vocabulary = tokenise.default_vocabulary()
    for text in filter(None, TEXTS):
        assert tokenise.decode(tokenise.encode([text], vocabulary)[0], vocabulary) == text
    assert tokenise.encode_corpus(docs(spark, [])).count() == 0


# Problem 9 ------------------------------------------------------------------------------------------------------------


def repeated(text, width=20):
    a = alnum(text)
    seen, mark = set(), [False] * len(a)
    for i in range(len(a) - width + 1):
        s = a[i : i + width]
        if s in seen:
            mark[i : i + width] = [True] * width
        seen.add(s)
    return len(a), sum(mark)


def test_repetition(spark):
    rng = random.Random(9)
    texts = ["", None, " ", "short", "x" * 20, "x" * 21, "ab" * 5000, "A sentence that is said again and again. " * 3, "Ａ sentence that is said again and AGAIN, " * 2]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(0, 200))) for _ in range(60)] + [chr(0x4E00 + i) * 3 for i in range(30)] + ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400)) for _ in range(20)]
    rows = list(enumerate(texts)) + [(0, texts[6])]
    got = repetition.score(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["total"], r["repeated"]) for r in got) == Counter((i, *repeated(t or "")) for i, t in rows)
    want = {i for i, t in rows if repeated(t or "")[1] and repeated(t or "")[1] >= 0.3 * repeated(t or "")[0]}
    assert {r["doc_id"] for r in repetition.found(docs(spark, rows)).collect()} == want
    by_share = sorted((r["share"], -r["llr"]) for r in got)
    assert [x[1] for x in by_share] == sorted(x[1] for x in by_share)


def test_repetition_of_nothing(spark):
    assert repetition.found(docs(spark, [])).count() == 0
    assert repetition.found(docs(spark, [(1, "no repetition at all here"), (2, None)])).count() == 0
    assert repetition.found(docs(spark, [(1, "z" * 400)])).count() == 1


def test_repetition_without_a_trusted_document(spark):
    fresh = lambda n, at: "".join(chr(0x4E00 + at + k) for k in range(n))
    rows = [(i, fresh(100 - n, 200 * i) + fresh(100, 5000 + 200 * i)[:n] * 2) for i, n in enumerate((36, 40, 44, 60, 80))]
    shares = {i: repetition.repeated_characters(t) for i, t in rows}
    assert all(0.25 < r / n < 0.45 for n, r in shares.values()), shares
    want = {i for i, (n, r) in shares.items() if r >= 0.3 * n}
    got = repetition.score(docs(spark, rows)).collect()
    assert want and {r["doc_id"] for r in got if r["is_repetitive"]} == want
    assert {r["doc_id"] for r in repetition.found(docs(spark, [rows[4]])).collect()} == {4}


def test_share_on_the_edge_is_a_case(spark):
    fresh = "".join(chr(0x4E00 + i) for i in range(140))
    text = fresh + fresh[:60]  # 60 repeated of 200
    assert repeated(text) == (200, 60)
    assert repetition.found(docs(spark, [(1, text), (2, text + "丂")])).count() == 1


# Problem 8 ------------------------------------------------------------------------------------------------------------


def contained(rows, items, n=50):
    out = set()
    for d, t in rows:
        a = alnum(t or "")
        for i, x in items:
            b = alnum(x or "")
            if any(b[k : k + n] in a for k in range(len(b) - n + 1)):
                out.add((d, i))
    return out


def test_leaks(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(12)] + [(20, ""), (21, None), (22, "too short"), (23, "ab" * 60), (24, "ab" * 60), (25, "新能源汽车动力电池" * 8)]
    rows = [(0, ""), (1, None), (2, "ab" * 500), (3, "新能源，汽车 动力电池" * 9), (4, "x")]
    for i, (_, text) in enumerate(items[:12]):
        letters = alnum(text)
        for extra in (-1, 0, 1, 40):
            at = rng.randrange(0, len(letters) - 51 - extra)
            piece = letters[at : at + 50 + extra]
            rows.append((100 + i * 10 + extra, word() + "-" + " ".join(piece[k : k + 7].upper() for k in range(0, len(piece), 7)) + ". " + word()))
    rows.append((100, rows[8][1]))
    want = contained(rows, items)
    sources = spark.createDataFrame([(i, t, 5, "clash") for i, t in items + items[:1]], "item_id long, item_text string, doc_id long, text string")
    assert {tuple(r) for r in leakage.found(docs(spark, rows), sources).collect()} == want and len(want) > 30
    in_passes = leakage.leaks(docs(spark, rows), sources, slack=None, block=500).select("doc_id", "item_id")
    assert {tuple(r) for r in in_passes.collect()} == want
    lengths = {(r["doc_id"], r["item_id"]): r["characters"] for r in leakage.leaks(docs(spark, rows), sources, slack=None).collect()}
    for (d, i), n in lengths.items():
        of = [x for x in rows if x[0] == d], [x for x in items if x[0] == i]  # some ids stand for two texts
        assert contained(*of, n) and not contained(*of, n + 1)
    assert leakage.found(docs(spark, []), sources).count() == 0 and leakage.found(docs(spark, rows), sources.limit(0)).count() == 0


def test_leaks_in_proximity(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefghijk") for _ in range(n))
    item = letters(200)
    near = letters(30) + item[10:45] + "inserted" + item[45:80] + letters(9) + item[80:120] + letters(20)
    far = item[:40] + letters(300) + item[40:80] + letters(300) + item[80:110]
    back = item[100:140] + letters(5) + item[50:90]
    rows = [(1, near), (2, far), (3, back), (4, letters(400)), (5, item[20:90])]
    got = {(r["doc_id"], r["kind"]): r["characters"] for r in leakage.leaks(docs(spark, rows), spark.createDataFrame([(7, item)], "item_id long, item_text string")).collect()}
    assert got == {(1, "proximity"): 110, (5, "exact"): 70}


def test_ngram_scores(spark):
    rng = random.Random(3)
    plain = lambda n: "".join(chr(rng.randint(0x4E00, 0x5E00)) for _ in range(n))
    rows = [(i, plain(400)) for i in range(60)] + [(100 + i, plain(60) * 7) for i in range(20)] + [(200, None), (201, ""), (202, "短")]
    got = {r["doc_id"]: r for r in repetition.ngram_scores(docs(spark, rows)).collect()}
    assert len(got) == len(rows) and all(got[i]["llr"] == 0 and got[i]["is_kept"] for i in (200, 201, 202))
    assert min(got[i]["llr"] for i in range(60)) > max(got[100 + i]["llr"] for i in range(20))
    assert repetition.ngram_scores(docs(spark, [])).count() == 0


# Problem 2 ------------------------------------------------------------------------------------------------------------

ITEMS = "id long, source_id long, title string, author string, published_at string, raw_content string, content_excerpt string, lines string, day string, line_no long"


def items(spark, rows):
    return spark.createDataFrame([(i, s, None, None, p, t, None, "clash", "clash", 4) for i, s, t, p in rows], ITEMS)


def test_repeated_lines(spark):
    rng = random.Random(2)
    notices = ["Share this story", "ＳＨＡＲＥ this, story!", "© 2020 All rights", "1234", "x", "--", "责任编辑：某某", "Zweite Zeile"]
    rows = []
    for i in range(600):
        source = [1, 1, 1, 2, 3, None][i % 6]
        lines = [f"unique {rng.random()}" if rng.random() < 0.5 else rng.choice(notices) for _ in range(rng.randint(1, 6))]
        if i % 97 == 0:
            lines.append("A rare line of nine or so")
        rows.append((i, source, "\r\n".join(lines) if i % 2 else "\n".join(lines), "2024-01-01"))
    rows += [(1000, 1, None, None), (1001, 1, "", None), (1002, 1, " \n ", None), (1003, 9, "Share this story\n" * 20, None), rows[0], rows[0]]
    fold = lambda x: "".join(c for c in unicodedata.normalize("NFKC", x).lower() if unicodedata.category(c)[0] == "L")
    one = {r[0]: r for r in rows if r[2] and r[2].strip()}
    size, where, places = Counter(r[1] for r in one.values()), defaultdict(set), []
    for i, s, t, _ in one.values():
        for n, line in enumerate(t.split("\n"), 1):
            if len(fold(line)) >= 2:
                where[s, fold(line)].add(i)
                places.append((i, n, s, fold(line)))
    want = {(i, n) for i, n, s, k in places if len(where[s, k]) >= 8 and len(where[s, k]) >= 0.02 * size[s]}
    got = [tuple(r) for r in boilerplate_lines.found(items(spark, rows)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 300
    text = {r["id"]: r["raw_content"] for r in boilerplate_lines.without_repeated(items(spark, rows)).collect()}
    assert "Share this story" not in text[10] and text[1000] is None and text[1003] == rows[603][2]
    assert boilerplate_lines.found(items(spark, [])).count() == 0


def test_counts_of_pages_and_days(spark):
    rows = [(i, 1, "Same line here\nbody" if i < 6 else f"Same line here\n{i}x", ["2024-01-01 23:00", "2 January 2024", "2024-01-04T01:00:00+08:00"][i % 3]) for i in range(12)]
    sources = spark.createDataFrame([(1, "en_GB", "Europe/London")], "id long, site_locale string, site_tz string")
    strict = lambda clusters=None, **k: {tuple(r)[2:] for r in boilerplate_lines.repeated_lines(boilerplate_lines.hashed_lines(items(spark, rows), sources, clusters), **k).collect()}
    assert strict(pages=2, days=3) == {(12, 2, 3)}  # 6 equal pages and 6 whose letters are equal: two clusters, three days
    assert strict(pages=3) == set() and strict(days=4) == set()
    assert strict(spark.createDataFrame([(i, 5) for i in range(6, 12)], "id long, group_id long"), pages=2) == {(12, 2)}
    assert strict() == {(12,)}


# Problem 6 ------------------------------------------------------------------------------------------------------------


def test_survivors(spark):
    raw = "id long, source_id long, author string, published_at string, raw_content string, content_excerpt string, event_id long, rank string"
    r = [
        (1, 1, " ", "2024-01-02", "long text", None), (2, 2, "Ann", "x", "short", None), (3, 2, None, "2024-01-03", "short", None), (4, 3, "Bob", None, None, "an excerpt"), (5, 3, "", None, "", "an excerpt"), (6, 9, None, None, None, None),
        (7, 4, "Cy", "2024-01-01 00:00:00", "tie", None), (8, 4, "Di", "2024-01-01 00:00:00", "tie", None), (9, 4, None, "2024-01-05", "tie", None),
    ]
    sources = spark.createDataFrame([(1, 0.9, "UTC", "en-GB"), (2, 0.0, "UTC", "en-GB"), (3, float("nan"), "UTC", "en-GB"), (4, 0.7, "UTC", "en-GB")], "id long, reliability_score double, site_tz string, site_locale string")
    events = {10: [1, 2, 3], 11: [4, 5], 12: [6], 13: [7, 8, 9], 14: [6, 5], 15: [99, 98]}
    processed = [(e * 100 + x, x, e) for e, xs in events.items() for x in xs] + [(1001, 1, 10), (7777, 1, None)]
    p = spark.createDataFrame([(*x, "clash") for x in processed], "id long, raw_item_id long, canonical_event_id long, author string")
    got = {t[0]: t[1:] for t in (tuple(x) for x in survivors.found(p, spark.createDataFrame([(*x, 5, "clash") for x in r], raw), sources).collect())}
    assert got[10] == (1001, 1002, 1001)  # trust first; the blank author passes on to the next item
    assert got[11] == (1104, 1104, -1)  # equal texts, unknown instants: the smaller raw id
    assert 12 not in got
    assert got[13] == (1309, 1307, 1309)  # same trust and length: the later instant
    assert got[14] == (1405, -1, -1)
    assert got[15][1:] == (-1, -1)
    assert survivors.found(p.limit(0), spark.createDataFrame([], raw), sources).count() == 0


def test_votes(spark):
    rows = spark.createDataFrame(
        [(1, "A ", 0.9, 0, 1), (1, "b", 0.5, 0, 2), (1, "B", 0.5, 0, 3), (1, None, 9.0, 0, 4), (2, "old", 1.0, 0, 5), (2, "new", 0.9, 86400 * 30, 6), (3, " ", 1.0, None, 7), (None, "x", 1.0, None, 8)],
        "g long, v string, trust double, s long, ord long",
    )
    call = lambda half: {r["g"]: (r["v"], r["v_votes"] and round(r["v_votes"], 6)) for r in survivors.vote(rows, "g", {"v": F.col("v")}, F.col("trust"), F.col("s"), half, F.col("ord")).collect()}
    assert call(None) == {1: ("B", 1.0), 2: ("old", 1.0), None: ("x", 1.0)}
    assert call(30.0)[2] == ("new", 0.9)
