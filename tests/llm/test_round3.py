"""Alignment of tokenizers, collocations and language-model scores against brute force,
and inputs that once went wrong."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import AWKWARD, frame, prose

from tagweave.llm import align, attention, itq, langid, linedup, lm, phrases, queries, tokenbin, urlfilter
from tagweave.llm.common import WordHash, coded_words, heavy_and_tail

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def crc(i):
    return zlib.crc32(str(i).encode())


# alignment

def odd_texts(n, seed=1):
    rng = random.Random(seed)
    parts = [*"abctheing12'.s,;:\n\t\r", "  ", " ", " ", " the", " ing", " ", " ", "▁", "é", "日", "<s>", "<|endoftext|>", "\x00", "'s", "'ll", "\x1c", "\x85", "😀"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)] + ["", " ", "  ", " a", "a ", "a  b", "▁x"]


def brute_alignment(a, b, text):
    raw = (" " + text).encode()
    ids_a, ids_b = a.encode([text])[0], b.encode([text])[0]
    if not text or b"".join(a.bytes[i] for i in ids_a) != raw or b"".join(b.bytes[i] for i in ids_b) != raw:
        return 0, 0, 0, Counter(), ""
    def places(ids, size):
        ends = np.cumsum([len(size[i]) for i in ids])
        return [(int(e) - len(size[i]), int(e), i) for e, i in zip(ends, ids)]
    pa_, pb = places(ids_a, a.bytes), places(ids_b, b.bytes)
    owner_a, owner_b = (np.repeat(np.arange(len(p)), [e - s for s, e, _ in p]) for p in (pa_, pb))  # the token over each byte
    links = Counter((ids_a[x], ids_b[y]) for x, y in set(zip(owner_a.tolist(), owner_b.tolist())))
    groups, at = [], [0, 0]
    for end in sorted({x[1] for x in pa_} & {y[1] for y in pb}):
        sides = []
        for k, side in enumerate((pa_, pb)):
            start = at[k]
            while at[k] < len(side) and side[at[k]][1] <= end:
                at[k] += 1
            sides.append(",".join(str(x[2]) for x in side[start : at[k]]))
        groups.append("|".join(sides))
    return len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def test_segments_align_like_whole_texts():
    aligner, texts = align.Aligner(A, B, known=50), odd_texts(1500)
    assert aligner.split
    for at in range(0, len(texts), 300):  # memory of segments is cleared in between
        part = texts[at : at + 300]
        got = aligner.texts(pa.array(part))
        for i, t in enumerate(part):
            n_a, n_b, n_groups, links, digest = brute_alignment(aligner.a, aligner.b, t)
            assert (got["n_a"][i], got["n_b"][i], got["n_groups"][i], got["n_links"][i], got["groups_sha256"][i].as_py()) == (n_a, n_b, n_groups, sum(links.values()), digest)
            assert dict(zip(got["keys"][i].as_py(), got["times"][i].as_py())) == {x * aligner.b.size + y: n for (x, y), n in links.items()}


@pytest.mark.parametrize("heavy", [1, 40, 1 << 18])
def test_alignment_counts_over_the_corpus(spark, heavy):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(40)), None) for i in range(60)] + [(100 + i, t, "x") for i, t in enumerate(odd_texts(60))] + AWKWARD
    got = align.align_tokenizers(spark, frame(spark, rows), A, B, heavy=heavy).collect()
    a, b = align.ByteBpe(A), align.PieceBpe(B)
    found = [(i, brute_alignment(a, b, t or "")) for i, t, _ in rows]
    counts = sum((f[3] for _, f in found), Counter())
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    want = [(i, f[0], f[1], f[2], sum(f[3].values()), sum(n for p, n in f[3].items() if counts[p] == most[p[1]]), sum(n * counts[p] for p, n in f[3].items()), f[4]) for i, f in found]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert got[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert align.align_tokenizers(spark, frame(spark, []), A, B).count() == 0


def test_heavy_keys_are_bounded(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1000, 500, *[1] * 300])], "key int, n bigint")
    for most in (1, 2, 5, 100):
        heavy, tail = heavy_and_tail(counts, heavy=most)
        assert heavy.count() <= most and heavy.count() + tail.count() == 302


# collocations

def brute_collocations(rows, top, longest=3, least=10, share=50):
    grams, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    grams.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, f in grams.items():
        rated = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(100 * f[q] >= share * a for q in f if len(q) > len(p) and f[q] >= least and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rated.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("longest, least", [(3, 10), (4, 3), (2, 5)])
def test_collocations_equal_brute_force(spark, monkeypatch, longest, least):
    rng = random.Random(3)
    texts = [(rng.choice(["en", "fr", None]), rng.choice([", ", " ", "\n"]).join(rng.choice(["red fox", "Red  fox runs", "a b c d", "the", "é x y", "o'er\tthe top", "x, y", "hot spot"]) for _ in range(rng.randrange(30)))) for _ in range(150)]
    texts += [("en", "hot spot " + str(i % 7)) for i in range(300)] + [(None, None), ("fr", ""), ("de", "one two")]
    df = frame(spark, [(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(5)
    monkeypatch.setattr(phrases, "PIECE_BYTES", 2000)
    got = phrases.collocations(spark, df, top=40, longest=longest, least=least).collect()
    assert sorted(map(tuple, got)) == brute_collocations(texts, 40, longest, least)
    assert got[0].__fields__ == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_a_hot_word_spans_ranges(spark):
    """One word begins and ends most phrases, over many ranges and batches of the streams."""
    texts = [("en", ", ".join(f"hot w{i} end" for _ in range(10))) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = frame(spark, [(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id bigint, text string, lang string")
        got = phrases.collocations(spark, df, share=101).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(map(tuple, got)) == brute_collocations(texts, 2000, share=101) and len(got) == 1200


def test_exact_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(2, 9 * 10**13, 10**14 - 1, 10**14 + 7)], "ord int, n bigint, l1 bigint, f1 bigint")
    score = row.select(phrases._cut(1, 2, lambda c: c.cast("decimal(15,0)")).getField("score")).first()[0]
    assert score == 10**6 * (9 * 10**13) ** 2 // ((10**14 - 1) * (10**14 + 7))


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark, frame(spark, [], "doc_id bigint, text string, lang string")).count() == 0
    assert phrases.collocations(spark, frame(spark, [(1, None, None), (2, "", "a")], "doc_id bigint, text string, lang string")).count() == 0


# language model

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TINY = attention.Shape(classes=8, members=16, bins=8, width=8, key=3, value=4, hidden=12, context=12, stride=8)


def lm_words(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def scored(spark, rows, **more):
    df = frame(spark, rows)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return lm.score_documents(spark, df, RANKS, public_tokenizers.PATTERN, fold == 2, fold != 2, TINY, **{"trainer_ids": 1 << 16, **more}).collect()


def test_words_encode_as_if_alone():
    encoder = lm.SubwordEncoder(RANKS, public_tokenizers.PATTERN)
    words = ["the", "blorvek", "é x", " ", "don't", "a ", "日本", "12.5%", "x" * 500, "\x1c", "  "]
    starts, ids = encoder.words(words)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [encoder.encoding.encode_ordinary(" " + w) for w in words]
    assert encoder.words([])[1].tolist() == []


@pytest.mark.parametrize("heavy", [1, 30, 1 << 18])
def test_unigram_base_equals_brute_force(spark, heavy):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(60), 200) + rng.choice(["", " rare%d" % i, " A b"]), None) for i in range(150)] + [r for r in AWKWARD if r[1] is None or len(r[1]) < 1000]
    got = scored(spark, rows, heavy=heavy)
    tokens = lambda t: [*lm_words(t), ""]
    learned = Counter(w for i, t, _ in rows if i is not None and crc(i) % 7 != 2 for w in tokens(t))
    n, v = sum(learned.values()), len(learned)
    want = sorted((i is not None, i or 0, i is not None and crc(i) % 7 == 2, len(tokens(t)), sum(w in learned for w in tokens(t)), n, round(sum(math.log10((learned[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t, _ in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_model_learns_order_on_held_out_text(spark):
    """Sentences of a fixed order: attention tells them better than word counts do, and
    shuffled words worse."""
    rng, order = random.Random(5), [f"w{i}" for i in range(40)]
    line = lambda n: " ".join(order[(s + j) % 40] for j in range(n)) if (s := rng.randrange(40)) >= 0 else ""
    rows = [(i, line(60), None) for i in range(300)]
    mixed = [(1000 + i, " ".join(rng.sample(order * 2, 60)), None) for i in range(300) if crc(1000 + i) % 7 == 2]
    got = {r.doc_id: r for r in scored(spark, rows + mixed, trainer_ids=1 << 20)}
    held = [got[i] for i, _, _ in rows if crc(i) % 7 == 2]
    assert held and sum(r.score for r in held) > 0.5 * sum(r.base_score for r in held)
    assert max(got[i].score for i, _, _ in mixed) < min(r.score for r in held)


def test_scores_agree_over_partitions_and_repeats(spark):
    rows = [(1, "one two three", None), (1, "one two three", None), (3, "x " * 500, None)]
    got = scored(spark, rows)
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and len(got) == 3
    assert scored(spark, []) == []
    alone = scored(spark, [(next(i for i in range(100) if crc(i) % 7 == 2), "a b", None)])[0]  # nothing to learn from
    assert (alone.train_tokens, alone.n_known, alone.base_score) == (0, 0, 0.0) and math.isfinite(alone.score)


def test_probabilities_add_up_to_one():
    """Over the model's ids at any position, and over the vocabulary inside them."""
    rng = np.random.default_rng(6)
    vocabulary = attention.Vocabulary(rng.integers(0, 50, 300), TINY)
    params = attention.init_params(vocabulary.share, TINY)
    scorer = attention.Scorer(params, vocabulary.share, TINY)
    cut = np.tile(rng.integers(0, TINY.ids, TINY.context + 1), (TINY.ids, 1))
    cut[:, -1] = np.arange(TINY.ids)
    assert abs((10 ** scorer.log10(cut)[:, -1]).sum() - 1) < 1e-5
    inside = np.bincount(vocabulary.model_id, 10.0 ** vocabulary.inside.astype(float), minlength=TINY.ids)
    assert np.allclose(inside[np.unique(vocabulary.model_id)], 1)


def test_gradient_and_scorer_agree_with_the_loss():
    shape = attention.Shape(classes=4, members=3, bins=2, width=5, key=3, value=4, hidden=6, context=6, stride=4, plain=0.0)
    rng = np.random.default_rng(7)
    params = {k: v.astype(np.float64) for k, v in attention.init_params(np.full(12, 1 / 12), shape).items()}
    cut = rng.integers(0, 13, (9, 7))  # 12 is the pad
    loss, gradient = attention.loss_and_gradient(params, cut, shape)
    for name, value in params.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name == "embed" and at[0] == 12:
                continue
            ends = []
            for step in (1e-5, -1e-5):
                near = {k: v.copy() for k, v in params.items()}
                near[name][at] += step
                ends.append(attention.loss_and_gradient(near, cut, shape)[0])
            assert abs((ends[0] - ends[1]) / 2e-5 - gradient[name][at]) < 1e-4, name
    scorer = attention.Scorer({k: v.astype(np.float32) for k, v in params.items()}, np.full(12, 1 / 12), shape)
    assert abs(scorer.log10(cut).sum() * np.log(10) / (cut[:, -4:] < 12).sum() + loss) < 1e-4


def test_every_id_is_scored_once_with_what_precedes_it():
    lengths = np.array([0, 1, 8, 9, 30])
    firsts = np.cumsum(lengths + 1) - lengths - 1
    flat = np.concatenate([np.arange(n + 1) for n in lengths])
    text, step = attention.windows(lengths, TINY)
    cut = attention.gather(flat, firsts, lengths, text, step, TINY)
    targets = [(t, x) for t, row in zip(text, cut[:, -TINY.stride :]) for x in row if x < TINY.ids]
    assert targets == [(t, x) for t, n in enumerate(lengths) for x in range(1, n + 1)]
    assert all(b == a + 1 for row in cut for a, b in zip(row, row[1:]) if a < TINY.ids and b < TINY.ids)


# inputs that once went wrong

def test_lines_that_share_half_a_hash():
    h1, h2 = np.array([5, 5, 9, 9, 9], np.uint64), np.array([1, 2, 1, 2, 3], np.uint64)
    arrays = linedup.ShardArrays.build(h1, h2, np.arange(5) + 2, np.arange(5))
    at = arrays.probe(h1, h2)
    assert sorted(at) == [0, 1, 2, 3, 4] and (arrays.firsts[at] == np.arange(5)).all()
    with pytest.raises(ValueError):
        linedup.build_mph(np.array([5, 5], np.uint64), np.array([1, 1], np.uint64))


def test_links_of_tiny_and_huge_vectors(spark):
    base = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, "a", base), (2, "a", [x * 1e-170 for x in base]), (3, "a", [x * 1e200 for x in base]), (4, "a", [-1e-300, 0.0, 0.0, 1e-300]), (5, "b", [5e-324, 0.0, 0.0, 0.0]), (6, "b", [1.0, 0.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq.link_vectors(spark, spark.createDataFrame(rows, "vec_id bigint, label string, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5)}


def test_bracketed_hosts_stay_apart(spark):
    urls = spark.createDataFrame([("http://[2001:db8::1]:80/x",), ("http://u@[2001:db8::2]/",), ("http://h.example:8/",)], "url string")
    assert [r[0] for r in urls.select(urlfilter.url_host(F.col("url"))).collect()] == ["[2001:db8::1]", "[2001:db8::2]", "h.example"]


def test_language_samples_come_from_all_over(spark):
    """Few very long texts: none is lost, none gives its beginning only."""
    rows = [(i, " ".join(["anfang"] * 3000 + ["mitte"] * 3000 + ["ende"] * 3000), "de") for i in range(30)] + [(100, "x", "fr"), (101, "123", "it"), (102, None, "es")]
    learned = langid.learn_samples(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert set(learned) == {"de", "fr"} and len(learned["de"]) == langid.SAMPLE_CHARS
    words = Counter(learned["de"].split())
    assert min(words["anfang"], words["mitte"], words["ende"]) > 500


def test_language_score_does_not_fall_with_more_languages():
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    samples = {f"l{i:02}": " ".join("".join(rng.choices(letters, rng.choices(range(1, 9), k=26), k=5)) for _ in range(300)) for i in range(30)}
    few, many = (langid.LanguageModel({k: f" {v} " for k, v in list(samples.items())[:n]}) for n in (4, 30))
    text = samples["l02"][200:900]
    assert few.predict(text)[0] == many.predict(text)[0] == "l02"
    assert many.predict(text)[1] > 0.9


def test_coded_words_are_the_contracts_words():
    rng = random.Random(9)
    texts = ["".join(rng.choice("aZ09 ./`{é日 \x7f\n_-") for _ in range(rng.randrange(30))) for _ in range(300)] + ["", "x"]
    from test_operators import words

    starts, index, dictionary, hashes = coded_words(pa.array(texts))
    for t, a, b in zip(texts, starts, starts[1:]):
        assert dictionary.take(pa.array(index[a:b])).to_pylist() == words(t)
        assert (hashes[index[a:b]] == WordHash().of(words(t))).all()


def test_other_tokenizers_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer

    whole = tokenbin.WordEncoder(A, 2)
    assert not whole.by_word  # its words begin with the space before them
    firsts, ids = whole.encode(pa.array(["a b", ""]))
    assert ids.tolist() == [*Tokenizer.from_file(A).encode("a b", add_special_tokens=False).ids, 2, 2] and firsts.tolist() == [0, 3, 4]


def test_collocation_sql_on_ties(spark, tmp_path):
    texts = [("en", "p q r, " * 10), ("en", "x y, " * 10), ("en", "m n, " * 12)]
    rows = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id bigint, text string, lang string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.sql(queries.OP12_SQL).fetchall()) == brute_collocations(texts, 2000) == sorted(map(tuple, phrases.collocations(spark, rows).collect()))


def test_every_training_window_is_learned_from(spark, monkeypatch):
    """The trainers are given all windows of all training rows, and take as many steps as that needs."""
    from tagweave.llm import attention

    seen = []
    real = lm.Stages.write
    monkeypatch.setattr(lm.Stages, "write", lambda self, df, name, *a, **k: seen.append((name, got := real(self, df, name, *a, **k))) or got)
    rng = random.Random(6)
    rows = [(i, prose(rng, 40 + i, 300), None) for i in range(150)]
    scored(spark, rows, trainer_ids=1 << 12)
    stage = dict(seen)
    lengths = [r.n for r in stage["encoded"].where("learn").selectExpr("length(ids) div 2 AS n").collect()]
    assert stage["windows"].count() == sum(-(-n // TINY.stride) for n in lengths)
    steps = []
    monkeypatch.setattr(attention, "train", lambda params, cuts, shape, n, *a: steps.append((len(cuts), n)) or params)
    weights = type("Held", (), {"value": attention.flatten(attention.init_params(np.full(TINY.ids, 1 / TINY.ids), TINY))})
    lm._trainer(weights, TINY, 2, 0.01)(pd.DataFrame({"place": range(2000), "cut": [b"\0" * 2 * (TINY.context + 1)] * 2000}))
    assert steps[0][1] * lm.STEP_WINDOWS >= steps[0][0]
