"""Operators that learn or search: held-out accuracy and recall against brute force."""

import random
from pathlib import Path

import numpy as np
import pytest

from skeinwork.functions.fold import alnum, mix64
from skeinwork.llm import boosting, lines, main_text, near_duplicates, residue
from skeinwork.llm.residue_words import notice, residue_share

ITEMS = "id long, source_id long, title string, raw_content string, content_excerpt string, text string, node long, lines string, print long"
FOLDER = Path("/root/testdata/sf0.001")


def items(spark, rows):
    return spark.createDataFrame([(i, s, t, c, e, "clash", 1, "clash", 1) for i, s, t, c, e in rows], ITEMS)


# Problem 3 ------------------------------------------------------------------------------------------------------------


def jaccard(a, b, width):
    x, y = ({t[i : i + width] for i in range(len(t) - width + 1)} or {t} for t in map(alnum, (a, b)))
    return len(x & y) / len(x | y)


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(len(out) * share)):
        out[rng.randrange(len(out))] = "".join(rng.choice("abcdefghij") for _ in range(5))
    return out


@pytest.mark.parametrize("width, least, shared", [near_duplicates.ITEMS, near_duplicates.EVENTS])
def test_near_pairs_against_brute_force(spark, width, least, shared):
    rng = random.Random(width)
    texts = []
    for _ in range(30):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(4, 120))]
        texts += [" ".join(words), " ".join(edited(rng, words, 0.03)), " ".join(edited(rng, words, 0.08)), " ".join(words[len(words) // 3 :] + words[: len(words) // 3])]
    texts += [texts[0], texts[0].upper(), "", None, " . ", "ab", "AB", "新能源汽车"]
    rows = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in enumerate(texts)] + [(0, texts[0], "clash", 1, 2)], "id long, text string, keys string, a long, rep long")
    members, links = near_duplicates.classes(rows, width, least, shared)
    got = {tuple(r) for r in near_duplicates.pairs(members, links).collect()}
    real = [i for i, t in enumerate(texts) if t and alnum(t)]
    want = {(i, j) for i in real for j in real if i < j and jaccard(texts[i], texts[j], width) >= least}
    assert not got - want
    assert len(got & want) >= 0.98 * len(want) and len(want) > 60
    groups = {r["id"]: r["group_id"] for r in near_duplicates.groups(members, links).collect()}
    assert set(groups) == set(real) and all(groups[a] == groups[b] for a, b in got)


def test_recall_just_above_the_least_similarity(spark):
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = []
    for k in range(600):
        n, alike = rng.randint(200, 1500), 0.502 + 0.098 * k / 600
        same = int(n * 2 * alike / (1 + alike)) + 8
        head = letters(same)
        texts += [head + letters(n + 7 - same), head + letters(n + 7 - same)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {tuple(r) for r in near_duplicates.pairs(*near_duplicates.classes(rows, *near_duplicates.ITEMS)).collect()}
    want = {(2 * k, 2 * k + 1) for k in range(600)}
    assert all(0.5 <= jaccard(texts[a], texts[b], 8) <= 0.61 for a, b in want)
    assert not got - want
    assert len(got) >= 0.99 * len(want), len(got)


def test_near_pairs_leave_out_and_empty(spark):
    rows = spark.createDataFrame([(1, "the same words are here"), (2, "the same words are here"), (3, "the same words are here!")], "id long, text string")
    out = near_duplicates.classes(rows, 8, 0.5, 2, spark.createDataFrame([(2,)], "id long"))
    assert {tuple(r) for r in near_duplicates.pairs(*out).collect()} == {(1, 3)}
    assert near_duplicates.pairs(*near_duplicates.classes(rows.limit(0), 8, 0.5)).count() == 0


def test_fingerprints_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    of = lambda x: near_duplicates.fingerprints(x, np.zeros(len(x), int), 1, 288)[0]
    for n in (5, 40, 900):
        agree = []
        for _ in range(60):
            x = mix64(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
            common = int(n * 0.75)  # n elements each, 0.6 alike
            agree.append((of(x[:n]) == of(x[n - common : 2 * n - common])).mean())
        assert abs(np.mean(agree) - common / (2 * n - common)) < 0.04


# Problems 1 and 4 -----------------------------------------------------------------------------------------------------


def test_residue_marks():
    full = ["404 not found", "please enable javascript to view this page. [76b137]", "${title} - ${company.name}", "lorem ipsum dolor sit amet elit sed", "____ trimmed ____ at ____, ____.", "占位文字占位文字占位文字", "【公司名称】于【日期】宣布,将在【地点】投资【金额】", "story.body.p2/story_byline"]
    none = ["the manual still prints \"page not found\" where the company should list hub motors, a dealer group noted in early spring.", "the plant sold 404 cells", "", "a b", "系统升级后公司恢复交付,新增产能十万套"]
    assert all(residue_share(x) > 0.6 or notice(x) for x in full), [(x, residue_share(x)) for x in full]
    assert all(residue_share(x) <= 0.35 and not notice(x) for x in none if len(x) < 60)


@pytest.fixture(scope="module")
def small():
    if not FOLDER.exists():
        pytest.skip("no test tables here")
    return str(FOLDER)


def synthetic(n=400):
    """Pages of two sites: sentences of a story among menus, notices, links and code."""
    rng = random.Random(4)
    company = lambda: "".join(rng.choice(["ka", "lo", "mi", "ru", "te", "vo"]) for _ in range(4)).capitalize()
    verbs, nouns, times = ["opened", "sold", "paused", "leased"], ["battery plants", "test vehicles", "hub motors", "data centres"], ["last week", "in late autumn", "before winter"]
    sentence = lambda: f"{company()} Motors {rng.choice(verbs)} {rng.randint(10, 999)} {rng.choice(nouns)} near {company()} {rng.choice(times)}, as costs fell."
    rows, truth = [], {}
    for i in range(n):
        title = f"{company()} Motors {rng.choice(verbs)} {rng.choice(nouns)} at {company()}"
        story = [sentence() + " " + sentence() for _ in range(rng.randint(2, 5))]
        site = i % 2
        head = ["Home | News | Sign in | Jobs board", "We use cookies to run this site. Accept all"][: rng.randint(1, 2)] + [title]
        tail = [f"Share this story: Mail Print ({rng.randint(1, 99)})", f"1. {company()} Motors {rng.choice(verbs)} {rng.choice(nouns)} at {company()}", f"© 2020 Site {site}. All rights reserved.", f"var a{site} = {rng.randint(1, 99)};"]
        text = head + story + tail
        rows.append((i, site, title, "\n".join(text), story[0]))
        truth[i] = {k for k, line in enumerate(text, 1) if line not in story and line != title}
    return rows, truth


def test_main_text(spark):
    rows, truth = synthetic()
    extra = [(900, 0, None, None, None), (901, 0, "t", "", None), (902, 0, "t", " \n", None), (903, None, None, "x", None)]
    got = main_text.found(items(spark, rows + extra + rows[:1])).collect()
    found = {(r["id"], r["line_no"]) for r in got if r["id"] < 900}
    want = {(i, k) for i, ks in truth.items() for k in ks}
    assert len(got) == len({tuple(r) for r in got})
    assert len(found & want) >= 0.98 * len(want) and len(found & want) >= 0.98 * len(found)
    body = {r["id"]: r["raw_content"] for r in main_text.main_text(items(spark, rows + extra)).collect()}
    assert "All rights" not in body[3] and rows[3][4] in body[3] and body[900] is None and body[901] == "" and len(body) == 404


def test_residue(spark):
    rows, _ = synthetic()
    bad = [(1000, 0, "t", "Home | News | Sign in | Jobs board\n502 Bad Gateway edge-12ab34\n© 2020 Site 0. All rights reserved.", None), (1001, 1, "t", None, "Please enable JavaScript to view this page. [77]"), (1002, 1, "t", "____ sold ____ at ____, ____.", " ")]
    quote = (1003, 0, "t", rows[0][4] + " The page still says 404 Not Found where Kalo Motors sold 30 hub motors near Rute last week, as costs fell.", rows[0][4])
    # No mark covers this wording; it is a near-duplicate of one that does.
    near = (1004, 0, "t", "Pleese enable JavaScript to view this page now", None)
    got = {tuple(r) for r in residue.found(items(spark, rows + bad + [quote, near] + bad[:1])).collect()}
    assert got >= {(1000, "raw_content"), (1001, "content_excerpt"), (1002, "raw_content")}
    assert not {i for i, _ in got} & ({r[0] for r in rows} | {1003})


#: Wordings that no mark lists.
UNLISTED = ["This page could not be loaded. Please check the address.", "The server is overloaded, please wait and reload.", "Error 418: connection refused by gateway", "Scripts must be enabled to display this page", "网页无法访问,请刷新重试", "请启用脚本后重新访问", "Die Webseite konnte nicht geladen werden, bitte später erneut prüfen.", "Ohne JavaScript wird der Artikel nicht angezeigt", "[headline placeholder] insert text here", "wort wort wort wort"]


def test_notices_without_a_mark():
    told = ["without javascript the console of rahelawyn dynamics shows nothing, so the traders wait", "home | news | sign in | jobs board", "we use cookies to run this site. accept all", "share this story: mail print", "the plant could not sell 404 cells last week, as costs fell", "服务器厂商宣布新增产能十万套,交付恢复", "der hersteller konnte 40 busse nicht liefern", ""]
    assert not [x for x in UNLISTED if residue_share(x.lower()) > residue.COVERED]
    assert all(notice(x.lower()) for x in UNLISTED), [x for x in UNLISTED if not notice(x.lower())]
    assert not [x for x in told if notice(x)]


def test_residue_in_unlisted_words(spark):
    rows, _ = synthetic()
    bad = [(1000 + k, k % 2, "t", f"Home | News | Sign in | Jobs board\n{x}", None) for k, x in enumerate(UNLISTED)]
    got = {tuple(r) for r in residue.found(items(spark, rows + bad)).collect()}
    assert got == {(r[0], "raw_content") for r in bad}


def test_models_without_labels(spark):
    one = items(spark, [(1, 1, "t", "a line\nanother", None)])
    assert residue.found(one).count() == 0 and main_text.found(one).count() == 0
    assert residue.found(one.limit(0)).count() == 0 and main_text.found(one.limit(0)).count() == 0
    long = "word " * 100_000
    assert main_text.line_numbers(items(spark, [(1, 1, long, long, long)])).count() == 1


def test_sample_is_bounded_and_stable(spark):
    rows, _ = synthetic()
    df = items(spark, rows)
    a, b = lines.sample(df, 50), lines.sample(df.repartition(7), 50)
    assert a == b and len(a) <= 50


def test_spread_reaches_whole_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10)] + [(50, 51)], "a long, b long")
    assert {r["node"] for r in residue.spread(edges, spark.createDataFrame([(3,), (99,)], "node long")).collect()} == {*range(11), 99}


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    forest = boosting.fit(x[:3000], y[:3000], np.ones(3000), trees=40)
    assert ((forest.margin(x[3000:]) > 0) == (y[3000:] > 0)).mean() > 0.95
    assert len(forest.margin(x[:0])) == 0


def test_on_the_test_tables(spark, small):
    from skeinwork.llm.queries import QUERIES

    for name in ("p1_found", "p4_found"):
        rows = QUERIES[name](spark, small).collect()
        assert rows and len(rows) == len(set(rows)), name
