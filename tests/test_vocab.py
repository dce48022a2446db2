"""Token counts, ranks and registries."""

from tagweave.operators import vocab as vb


def _counts(spark, rows):
    df = spark.createDataFrame(rows, "prevalence long, label string")
    return {r["token"]: r["count"] for r in vb.general_token_counts(df).collect()}


def test_general_token_counts_rules(spark):
    got = _counts(spark, [
        (10, "=_="),                          # short: counted whole
        (3, "0"),                             # short but zero-looking: dropped
        (5, "orange_(fruit)_(meme)"),         # qualifiers counted, rest split
        (7, "nero_(fate)_(cosplay)"),         # cosplay: nominal counted whole
        (2, "a_00_b-c"),                      # split parts, zero part dropped
        (4, "x__yy_()"),                      # empty qualifier is counted
    ])
    assert got["=_="] == 10
    assert "0" not in got and "00" not in got
    assert got["fruit"] == 5 and got["meme"] == 5 and got["orange"] == 5
    assert got["cosplay"] == 7 and got["nero_(fate)"] == 7
    assert got["a"] == 2 and got["b"] == 2 and got["c"] == 2
    assert got[""] == 4 and got["x"] == 4 and got["yy"] == 4


def test_ranked_order_and_threshold(spark):
    counts = spark.createDataFrame([("a", 40), ("b", 40), ("c", 50), ("d", 30)],
                                   "token string, count long")
    rows = vb.general_tokens(counts, 31).orderBy("rank").collect()
    assert [r["token"] for r in rows] == ["c", "b", "a"]  # count desc, token desc
    assert [r["rank"] for r in rows] == [0, 1, 2]


def test_registry_a_first_occurrence(spark):
    labels = spark.createDataFrame([(0, "x"), (1, "y")], "rank long, token string")
    general = spark.createDataFrame([(0, "y"), (1, "z"), (2, "")], "rank long, token string")
    reg = {r["token"]: r["id"] for r in vb.registry_a(spark, labels, general).collect()}
    assert reg == {"<pad>": 0, "<unk>": 1, "x": 2, "y": 3, "z": 4}


def test_registry_b_labels_minus_general_and_add_tokens(spark):
    labels = spark.createDataFrame([(0, "x"), (1, "y")], "rank long, token string")
    general = spark.createDataFrame([(0, "y"), (1, "z")], "rank long, token string")
    reg = vb.registry_b(spark, labels, general, extra_ids=3)
    got = {r["token"]: r["id"] for r in reg.collect()}
    assert got == {"<pad>": 0, "</s>": 1, "<unk>": 2, "x": 3, "y": 4, "z": 5,
                   "<extra_id_0>": 6, "<extra_id_1>": 7, "<extra_id_2>": 8}
    assert vb.duplicate_tokens(reg).count() == 0
    more = spark.createDataFrame([("new",), ("x",)], "token string")
    added = {r["token"]: r["id"] for r in vb.add_tokens(reg, more).collect()}
    assert added["new"] == 9 and added["x"] == 3 and len(added) == 10
    assert vb.vocab_size(reg, 3).collect()[0][0] == 12
