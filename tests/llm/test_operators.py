"""Each operator against brute force or an exact round trip, and on awkward rows:
nulls in any column, empty and long texts, ties, repeated rows, empty tables and
extra columns with clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagweave.llm import dartminhash, decontam, itq, langid, linedup, mixing, quality, sitestyle, tokenbin, urlfilter
from tagweave.llm.common import WORD, Stages, lower_word
from tagweave.llm.graph import connected_components

LONG = " ".join(f"word{i % 977}" for i in range(20000))
AWKWARD = [(None, None, None), (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (3, " \n\t ", None), (4, "tie", "b"), (4, "tie", "b"),
           (None, "no id here", "b"), (5, LONG, "a"), (6, LONG + " end", "a")]
SCHEMA = "doc_id bigint, text string, source string"
CLASHING = "key d t1 t2 row h n pos line lines drop size source_size target s z component vertex"


def frame(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    for c in CLASHING.split():
        df = df.withColumn(c, F.lit(f"x-{c}"))
    return df


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def words(text):
    return [lower_word(w) for w in WORD.findall(text or "")]


# mixing

def best_sum(sizes, counts, budget):
    sums = {0}
    for s, c in zip(sizes, counts):
        sums = {a + s * k for a in sums for k in range(c + 1) if a + s * k <= budget}
    return max(sums)


def test_knapsack_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        sizes = sorted(rng.sample(range(1, 40), rng.randrange(1, 6)))
        counts = [rng.randrange(0, 5) for _ in sizes]
        budget = rng.randrange(0, 150)
        got = mixing.knapsack(np.array(sizes), np.array(counts), budget)
        assert all(0 <= g <= c for g, c in zip(got, counts))
        assert int((got * sizes).sum()) == best_sum(sizes, counts, budget)


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 60)), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for i in range(600)] + AWKWARD[:8]
    got = mixing.mix(spark, frame(spark, rows)).toPandas()
    again = mixing.mix(spark, frame(spark, rows).repartition(3)).toPandas()
    order = ["doc_id", "h", "taken"]
    assert got.sort_values(order, ignore_index=True)[order].equals(again.sort_values(order, ignore_index=True)[order])
    assert len(got) == len(rows)
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    assert got["size"].sum() == sum(size)
    sources = sorted({s for *_, s in rows if s is not None}) + [None]
    weight = dict(zip(sources, [3, 1, 2] * 3))
    cap = {s: 2 * sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    target, open_ = {}, set(sources)
    while True:  # reshare until none is above its cap
        rest = 1.5 * sum(size) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] >= cap[s]}
        if not above:
            break
        target |= {s: cap[s] for s in above}
        open_ -= above
    target |= share
    for s, part in got.groupby(got["source"].where(got["source"].notna(), "none")):
        s = None if s == "none" else s
        assert abs(part["target"].iloc[0] - target[s]) < 1e-6
        assert abs(part["taken"].sum() - target[s]) <= 1
    assert (got["taken"] <= 2 * got["size"]).all()
    out = mixing.mixed_documents(spark, frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in out.collect()) == got["taken"].sum()
    assert mixing.mix(spark, frame(spark, [])).count() == 0


# language identification

def test_automaton_knows_exactly_the_substrings():
    text = "abcabxabcd aab" * 3
    a = langid.Automaton(text, "abcdx ")
    code = {c: i + 1 for i, c in enumerate("abcdx ")}
    for probe in ("abc", "bxa", "dd", "xx", "abcabxabcd aababcab", "q", "abqab"):
        n, at = 0, 0
        while at < len(probe):
            m = max((k for k in range(len(probe) - at + 1) if probe[at : at + k] in text), default=0)
            n, at = n + 1, at + max(1, m)
        assert a.phrases(bytes(code.get(c, 0) for c in probe)) == n, probe


def test_language_of_held_out_text(spark):
    rng = random.Random(3)
    parts = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["str", "ing", "er", "th"], "zz": ["oui", "eau", "ch", "que"]}
    text = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(40))
    rows = [(i, text(lang := rng.choice(list(parts))), lang) for i in range(300)]
    docs = spark.createDataFrame(rows + [(900, None, "xx"), (901, "123 !?", "xx"), (902, "", None), (None, "kalomi tukalo", "yy")], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(spark, docs, langid.training_fold(docs)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[None].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_known(spark, docs.withColumn("lang_pred", F.lit("mine")).withColumn("k0", F.lit(1)), langid.training_fold(docs))
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred", "k0"] and kept.count() == 301
    assert langid.identify(spark, docs.limit(0), docs.limit(0)).count() == 0


def test_many_alphabets_and_languages(spark):
    rng = random.Random(31)
    starts = {"el": 0x3B1, "ru": 0x430, "hy": 0x561, "ka": 0x10D0, "hi": 0x905, "th": 0xE01, "zh": 0x4E00, "ja": 0x3041, "ko": 0xAC00, "am": 0x1200}
    text = lambda first, n: " ".join("".join(chr(first + int(n * rng.random() ** 2)) for _ in range(4)) for _ in range(60))
    rows = [(i, text(starts[lang], 600 if lang in ("zh", "ko") else 24), lang) for i, lang in enumerate(sorted(starts) * 12)]
    rows += [(500 + i, text(0x61, 26), "aa") for i in range(12)] + [(600, "tiny", "bb")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {(r.doc_id, r.lang_pred) for r in langid.identify(spark, docs, docs).collect()} == {(i, lang) for i, _, lang in rows}
    many = spark.createDataFrame([(i, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} ab", f"l{i}") for i in range(300)], "doc_id bigint, text string, lang string")
    assert all(r.lang_pred == f"l{r.doc_id}" for r in langid.identify(spark, many, many).collect())


def test_sparse_automata_answer_as_flat_ones():
    rng = random.Random(32)
    samples = {lang: prose(rng, 300, 50 + 40 * i) + chr(300 + i) for i, lang in enumerate("abc")}
    flat, sparse = langid.LanguageModel(samples), langid.LanguageModel(samples, flat=0)
    assert all(flat.predict(t) == sparse.predict(t) for t in (prose(rng, 30) for _ in range(20)))


# quality

def test_quality_on_held_out_labels(spark):
    rng = random.Random(4)
    good = lambda: " ".join(prose(rng, 12).capitalize() + "." for _ in range(6))
    bad = lambda: ("BUY!! " * 30) if rng.random() < 0.5 else "### " + " | ".join(prose(rng, 1) for _ in range(40))
    rows = [(i, good() if i % 5 else bad()) for i in range(900)] + [(1000, None), (1001, ""), (None, "x")]
    labels = [(i, int(i % 5 > 0)) for i in range(0, 900, 2)] + [(None, 1), (7, None)]
    docs, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % 3 != 1
    got = {r.doc_id: r.score for r in quality.score_quality(spark, docs, lab, fold).collect()}
    held = [i for i, _ in rows[:900] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 5 > 0) for i in held]) >= 0.95
    assert len(got) == 903 and all(0 <= s <= 1 for s in got.values())
    assert {r.score for r in quality.score_quality(spark, docs, lab.limit(0), fold).collect()} == {0.5}


# pages

@pytest.mark.parametrize("html, text", [
    ("<body><nav>x</nav><article><h1>T &amp; a</h1><p><b>u v<br><p>w&nbsp;x <i>y</i>z</p><div class='ad'>q</div><p>k &am", "T & a\nu v\nw x yz\nk &am"),
    ("<p>one<p>two<ul><li>a<li>b</ul>tail", "one\ntwo\na\nb\ntail"),
    ('<div id="commentList">c</div>x <b>y</b> < 3 <script>if(a<b)"</p>"</script> z<p', "x y < 3\nz"),
    ("<article>a<footer>f</footer><header><h1>h</h1></header>b<form>q</form></article>c", "a\nh\nb"),
    ("<header>h</header><aside>s</aside><div class='cookie-notice'>c</div><main><p>m</p></main><footer>f</footer>", "m"),
    ("<style>p{}</style><!-- no <p> --><p>yes</p><!-- open", "yes"), (None, ""), ("", ""), ("plain", "plain"),
    ("<div class=\"x>unclosed <p>t</p>", "unclosed\nt"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
])
def test_page_text(html, text):
    assert sitestyle.main_text(sitestyle.parse(html)[0]) == text


def test_style_tree_removes_what_a_host_repeats(spark):
    page = lambda i: (f"<div class=top>Welcome to the site</div><div class=body><p>story {i} first</p><p>story {i} second</p></div><div class=end>All rights</div>")
    rows = [(i, f"http://Host.example/{i}", page(i)) for i in range(20)] + [(90, "http://other.example/", page(90)), (91, None, page(91)), (None, "http://host.example/", None)]
    rows.append(rows[3])
    got = sitestyle.extract_pages(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("x"))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None and r.page_id < 20:
            assert r.text == f"story {r.page_id} first\nstory {r.page_id} second"
        elif r.page_id is not None:  # a host of one page, and no host: nothing to tell by
            assert r.text.startswith("Welcome") and r.text.endswith("All rights")
        else:
            assert r.text == ""


def page_texts(spark, pages):
    rows = [(i, f"http://host.example/{i}", html) for i, html in enumerate(pages)]
    return {r.page_id: r.text for r in sitestyle.extract_pages(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_style_tree_judges_inside_and_beside_articles(spark):
    share, story = "<div>Share this story with friends</div>", "<p>story {0} first</p><p>story {0} second</p>"
    pages = [f"<article><h1>Title {i}</h1>{story.format(i)}{share}</article><div>All rights</div>" for i in range(20)]
    pages += [pages[4]] * 30 + [pages[4] + f"<!-- {i} -->" for i in range(30)]  # copies of one article cost it nothing
    got = page_texts(spark, pages)
    assert got[3] == "Title 3\nstory 3 first\nstory 3 second"
    assert {got[i] for i in (4, *range(20, 80))} == {"Title 4\nstory 4 first\nstory 4 second"}
    teaser = [f"<article class=card><p>Teaser {i}</p></article><div class=body><div>a long text {i} in plain divs</div><div>and more of {i}</div></div><div class=end>All rights</div>" for i in range(20)]
    assert page_texts(spark, teaser)[7] == "Teaser 7\na long text 7 in plain divs\nand more of 7"
    assert page_texts(spark, teaser[:2])[1].startswith("Teaser 1\na long text 1 in plain divs\nand more of 1")


@pytest.mark.parametrize("html, text", [
    ("<div class='layout has-sidebar'><article><p>a</p></article></div>", "a"), ("<article class='post no-comments'><p>a</p></article>", "a"),
    ("<main id='with-nav'>a</main>", "a"), ("<div class='sidebar'><p>x</p><article><p>a</p></article></div>", "a"),
    ("<article><h2 id='related-work'>a</h2><section id='social-security'>b</section><p class='notice'>c</p><div class='alert-box'>d</div></article>", "a\nb\nc\nd"),
    ("<article>a<div class='share'>x</div><div id='comments'>x</div><div class='social-share'>x</div></article>", "a"),
    ("<div class='layout has-sidebar'><p>a</p></div><div class='sidebar-left'>x</div>", "a"),
])
def test_names_remove_furniture_only(html, text):
    assert sitestyle.main_text(sitestyle.parse(html)[0]) == text


def test_style_tree_confirms_names_in_part(spark):
    pages = [f"<article><p>story {i}</p><div class='alert-box'>box {i}</div><div class='post-related'>More by theme {i % 3}</div></article>" for i in range(30)]
    assert page_texts(spark, pages)[5] == "story 5\nbox 5"


# line de-duplication

def test_minimal_perfect_hash():
    rng = np.random.default_rng(5)
    h1, h2 = (rng.integers(0, 2**63, 3000).astype(np.uint64) for _ in range(2))
    arrays = linedup.ShardArrays.from_bytes(linedup.ShardArrays.build(h1, h2, np.arange(3000) + 2, np.arange(3000)).to_bytes())
    at = arrays.probe(h1, h2)
    assert sorted(at) == list(range(3000)) and (arrays.firsts[at] == np.arange(3000)).all() and (arrays.counts[at] == np.arange(3000) + 2).all()
    assert (arrays.probe(h1, h2 + np.uint64(1)) == -1).all() and (arrays.probe(h2, h1) == -1).all()


def brute_lines(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(2**63 - 1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= 10 and len(h := holders[key(x)]) > 1 and (2**63 - 1 if i is None else i) != min(h) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    pool = [f"Line number {i} of the pool" for i in range(40)] + ["short", "", "  Padded line here\t", "padded LINE here", "ÄÖÜ ünïcödé line", "\x0bten chars!"]
    rows = [(rng.randrange(150) if rng.random() < 0.9 else None, "\n".join(rng.choices(pool, k=rng.randrange(0, 9)))) for _ in range(250)] + [(i, t) for i, t, _ in AWKWARD] + [(i, "One very common line\n" + str(i)) for i in range(300, 700)]
    got = linedup.dedup_lines(spark, frame(spark, [(i, t, None) for i, t in rows])).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got], key=repr) == brute_lines(rows)
    assert linedup.dedup_lines(spark, frame(spark, [])).count() == 0


# URL filters

def test_url_filters_by_time(spark):
    day = "2024-01-%02d 00:00:00"
    events = [("l", "block", "domain", "bad.example", "add", day % 5), ("l", "block", "domain", "bad.example", "remove", day % 10), ("l", "block", "domain", "bad.example", "remove", day % 12),
              ("m", "allow", "url", "http://a.bad.example/ok", "add", day % 1), ("l", "block", "host", "x.example", "add", day % 3), ("l", "block", "host", "x.example", "remove", day % 3),
              ("n", "block", "domain", "bad.example", "add", day % 9), (None, "block", "host", "y.example", "add", day % 1)]
    pages = [(1, "http://a.bad.example/p", day % 4), (2, "http://a.bad.example/p", day % 5), (3, "HTTP://A.bad.example/ok#frag", day % 6), (4, "http://bad.example./", day % 10),
             (5, "http://notbad.example/", day % 6), (6, None, day % 6), (7, "no url", day % 6), (8, "http://bad.example/", None), (9, "http://x.example/", day % 4), (9, "http://x.example/", day % 4)]
    e = spark.createDataFrame(events, "list string, verdict string, kind string, key string, action string, at string").withColumn("at", F.to_timestamp("at"))
    p = spark.createDataFrame(pages, "page_id bigint, url string, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at")).withColumn("host", F.lit("z"))
    got = [(r.page_id, r.n_block, r.n_allow, r.lists, r.blocked) for r in urlfilter.filter_urls(p, e).collect()]
    assert sorted(got) == [(1, 0, 0, "", False), (2, 1, 0, "l", True), (3, 1, 1, "l,m", False), (4, 1, 0, "n", True), (5, 0, 0, "", False), (6, 0, 0, "", False),
                           (7, 0, 0, "", False), (8, 0, 0, "", False), (9, 0, 0, "", False), (9, 0, 0, "", False)]
    assert not any(r.blocked for r in urlfilter.filter_urls(p, e.limit(0)).collect())


# decontamination

def test_decontamination_equals_brute_force(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, n, 60)) for i, n in enumerate([25, 10, 9, 3, 2, 1, 40])] + [(50, None), (51, "..."), (None, prose(rng, 12, 60)), (1, prose(rng, 14, 60))]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randrange(0, 30), 300)]
        if i % 3 == 0:
            _, text = rng.choice([x for x in items if x[1]])
            w = text.split()
            a = rng.randrange(len(w))
            parts.append(", ".join(w[a : a + rng.randrange(1, 20)]).upper())
        rows.append((i, " ".join([*parts, prose(rng, 5, 300)])))
    rows += [(i, t) for i, t, _ in AWKWARD]
    windows = {tuple(w[a : a + min(10, len(w))]): set() for i, t in items if i is not None and (w := words(t)) for a in range(max(1, len(w) - 9))}
    for i, t in items:
        if i is not None and (w := words(t)):
            for a in range(max(1, len(w) - 9)):
                windows[tuple(w[a : a + min(10, len(w))])].add(str(i))
    want = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        want.append((i, len(w), len(hit), sorted(found), bool(hit)))
    docs, bench = frame(spark, [(i, t, None) for i, t in rows]), spark.createDataFrame(items, "item_id bigint, text string").withColumn("words", F.lit(1))
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontam.decontaminate(spark, docs, bench).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    clean = decontam.drop_contaminated(spark, docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[4] for w in want)
    assert not any(r.contaminated for r in decontam.decontaminate(spark, docs, bench.limit(0)).collect())
    assert decontam.decontaminate(spark, docs.limit(0), bench).count() == 0


# near duplicates

def brute_classes(rows, k=5, similar=0.8):
    grams = {}
    for i, t in rows:
        w = words(t)
        if i is not None and w:
            from collections import Counter
            grams.setdefault(i, Counter(tuple(w[a : a + min(k, len(w))]) for a in range(max(1, len(w) - k + 1))))
    ids, parent = sorted(grams), {i: i for i in grams}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            low = sum((grams[a] & grams[b]).values())
            if low / (sum(grams[a].values()) + sum(grams[b].values()) - low) >= similar:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    rows, base = [], prose(rng, 150, 3000)
    for i in range(260):  # a cloud of copies with more and more changes, chains and unrelated texts
        w = base.split() if i % 2 else prose(rng, rng.randrange(1, 80), 3000).split()
        for _ in range(rng.randrange(0, 9) if i % 2 else 0):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(300 + i, rows[4][1].upper()) for i in range(20)] + [(400, "one two"), (401, "One, two!"), (402, None), (403, ""), (404, " . ")] + [(500, LONG), (501, LONG + " end"), (400, "one two")]
    want = brute_classes(rows)
    docs = frame(spark, [(i, t, None) for i, t in rows] + [(None, base, None)])
    classes = dartminhash.near_duplicates(spark, docs)
    got = classes.collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert r.class_id == (None if r.doc_id is None else want.get(r.doc_id, r.doc_id)), r
    kept = dartminhash.keep_one(docs, classes)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()) | {402, 403, 404})
    assert dartminhash.near_duplicates(spark, frame(spark, [])).count() == 0


def test_one_id_with_two_texts(spark):
    rng = random.Random(33)
    a, b = prose(rng, 120, 5000), prose(rng, 90, 5000)
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, prose(rng, 50, 5000)), (1, ""), (1, " . "), (1, a), (5, b.upper())]
    docs = frame(spark, [(i, t, None) for i, t in rows])
    classes = dartminhash.near_duplicates(spark, docs).cache()
    assert sorted((r.doc_id, r.class_id) for r in classes.collect()) == sorted((i, 1 if i != 4 else 4) for i, _ in rows)
    assert classes.where("component is not null").select("component").distinct().count() == 3
    assert sorted((r.doc_id, r.text) for r in dartminhash.keep_one(docs, classes).collect()) == sorted([(1, a), (1, b), (1, ""), (1, " . "), (4, rows[4][1])])


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(9)
    a = rng.integers(0, 2**63, 200).astype(np.uint64)
    b = np.concatenate([a[:150], a[:30], rng.integers(0, 2**63, 20).astype(np.uint64)])
    x, y = dartminhash.signatures([a, b], 3000)
    low = 150
    assert abs((x == y).mean() - low / (200 + 200 - low)) < 0.03


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (200, 201), (None, 3), (-5, 30)]
    got = {r.vertex: r.component for r in connected_components(Stages(spark, "t"), spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: -5 for i in range(61)}, -5: -5, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


# vectors

def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(10)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(64)
        for _ in range(25):
            rows.append((len(rows), c % 3, (centre + rng.standard_normal(64) * rng.uniform(0, 0.35)).astype(np.float32).tolist()))
    rows += [(400 + i, 1, rows[0][2]) for i in range(5)] + [(410 + i, 0, rows[0][2]) for i in range(30)]
    rows += [(500, 0, None), (501, 0, [0.0] * 64), (502, None, rows[0][2]), (503, 0, [float("nan")] * 64), (504, 0, [1.0, 2.0]), (505, 0, [2.0, 4.0]), (506, 0, []), (None, 0, rows[0][2]), (507, 0, [float("inf")] * 64)]
    good = [(i, l, np.array(v, np.float32).astype(float)) for i, l, v in rows if i is not None and l is not None and v and np.isfinite(v).all() and np.any(v)]
    links, parent = {i: 0 for i, *_ in good}, {i: i for i, *_ in good}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n_true = 0
    for n, (i, l, v) in enumerate(good):
        for j, m, u in good[n + 1 :]:
            if l == m and len(u) == len(v) and v @ u / np.linalg.norm(v) / np.linalg.norm(u) >= 0.93:
                links[i] += 1
                links[j] += 1
                n_true += 1
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    got = itq.link_vectors(spark, spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").withColumn("code", F.lit(1))).collect()
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got) / 2
    assert 0.97 * n_true <= found <= n_true
    for r in got:
        assert r.n_links <= links.get(r.vec_id, 0)
        if links.get(r.vec_id, 0) == 0:
            assert r.component_id == r.vec_id and r.kept
    assert sum(r.component_id == find(r.vec_id) for r in got if r.vec_id in parent) >= 0.97 * len(good)
    assert itq.link_vectors(spark, spark.createDataFrame([], "vec_id bigint, label int, embedding array<float>")).count() == 0


def structured(rng, dims, rank, n, cosine):
    """Unit vectors of ``dims`` numbers in ``rank`` dimensions, each with one at ``cosine``."""
    basis = np.linalg.qr(rng.standard_normal((dims, rank)))[0].T
    a, b = rng.standard_normal((2, n, rank))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    return np.vstack([a, b]) @ basis


@pytest.mark.parametrize("dims, rank", [(64, 64), (384, 64), (768, 100)])
def test_links_of_long_structured_vectors(spark, dims, rank):
    x = structured(np.random.default_rng(14), dims, rank, 700, 0.935)
    n_true = (np.triu(x @ x.T, 1) >= 0.93).sum()
    got = itq.link_vectors(spark, spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, label int, embedding array<double>")).collect()
    assert n_true >= 700 and 0.97 * n_true <= sum(r.n_links for r in got) / 2 <= n_true


# token files

def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_pack_and_unpack():
    rng = np.random.default_rng(11)
    for bits in (1, 7, 8, 13, 16, 31, 32):
        ids = rng.integers(0, 2**bits, 1000).astype(np.uint32)
        plain = np.packbits(((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8).reshape(-1), bitorder="little")
        assert tokenbin.pack(ids, bits) == plain.tobytes()
        assert (tokenbin.unpack(tokenbin.pack(ids, bits), 1000, bits) == ids).all()
    assert [tokenbin.bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_token_file_random_access(tmp_path):
    rng = np.random.default_rng(12)
    docs = [(i if i else None, rng.integers(0, 5000, rng.integers(0, 300)).astype(np.uint32)) for i in range(50)]
    w = tokenbin.TokenWriter(f"{tmp_path}/a.tok", 5000, block=128)
    for i, ids in docs:
        w.add(i, ids)
    w.close()
    r = tokenbin.TokenReader(f"{tmp_path}/a.tok")
    flat = np.concatenate([ids for _, ids in docs])
    assert r.bits == 13 and r.n_ids == len(flat)
    for a, b in ((0, 1), (100, 400), (127, 129), (len(flat) - 1, len(flat)), (5, 5)):
        assert (r.ids(a, b) == flat[a:b]).all()
    assert [(i, ids.tolist()) for i, _, ids in r.documents()] == [(i, ids.tolist()) for i, ids in docs]


def test_words_encode_like_whole_texts():
    texts = ["Hello  World\nit's a  test's", "Ünï\tcödé 123abc", "", " ", "é e ́x", "<|endoftext|> a<|endoftext|>b", "ΑΣ ΣΑΣ. Σ", "tab\tx　y\x0bz\r\nq"]
    by_word, whole = tokenbin.WordEncoder(tokenizer(), 2), tokenbin.WordEncoder(tokenizer(), 2, by_word=False)
    assert by_word.by_word and not whole.by_word
    assert all((a == b).all() for a, b in zip(by_word.encode(pa.array(texts)), whole.encode(pa.array(texts))))


def test_token_files_round_trip(spark):
    rng = random.Random(13)
    rows = [(rng.randrange(10**12), prose(rng, rng.randrange(0, 50)), None) for _ in range(300)] + [r for r in AWKWARD]
    got = tokenbin.token_files(spark, frame(spark, rows), tokenizer()).orderBy("start").collect()
    encoder = tokenbin.WordEncoder(tokenizer(), 2, by_word=False)
    firsts, flat = encoder.encode(pa.array([t or "" for _, t, _ in rows]))
    ids = [flat[a:b] for a, b in zip(firsts[:-1], firsts[1:])]
    crc = lambda x: zlib.crc32(x.astype("<u4").tobytes())
    want = sorted(((i is not None, i or 0, len(x), crc(x)) for (i, *_), x in zip(rows, ids)))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    named = [r.doc_id for r in got if r.doc_id is not None]
    assert named == sorted(named)
    assert tokenbin.token_files(spark, frame(spark, []), tokenizer()).count() == 0


def test_entry_registers_all(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert hashlib.sha256(b"").hexdigest()  # the digest of texts without items
