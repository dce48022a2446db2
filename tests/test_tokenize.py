"""Rule-A / rule-B tokenisation against hand-checked examples."""

from pyspark.sql import functions as F

from tagweave.config import PAD_TOKEN, UNK_TOKEN
from tagweave.operators import tokenize as tk
from tagweave.operators import vocab as vb

# Vocabulary and expected tokens of the nine documented label examples.
VOCAB = ["nero_claudius_(fate)", "cosplay", "orange", "fruit", "meme", "coffee", "maker",
         "object", "dragon", "ball", "dragon_ball", "looking", "at", "viewer", "jinx",
         "league_of_legends", "=_=", "v", "shaped", "eyebrows"]
GOLDEN = {
    "nero_claudius_(fate)_(cosplay)": ["nero_claudius_(fate)", "cosplay"],
    "nero_claudius_(swimsuit_caster)_(fate)_(cosplay)": ["<unk>", "cosplay"],
    "orange_(fruit)_(meme)": ["orange", "fruit", "meme"],
    "coffee_maker_(object)": ["coffee", "maker", "object"],
    "dragon_ball_(object)": ["dragon", "ball", "object"],
    "looking_at_viewer": ["looking", "at", "viewer"],
    "jinx_(league_of_legends)": ["jinx", "league_of_legends"],
    "=_=": ["=_="],
    "v-shaped_eyebrows": ["v", "shaped", "eyebrows"],
}


def _vocab(spark, tokens):
    general = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "rank long, token string")
    labels = spark.createDataFrame([], "rank long, token string")
    return tk.materialize_vocab(vb.registry_a(spark, labels, general), PAD_TOKEN, UNK_TOKEN)


def test_rule_a_golden(spark):
    vocab = _vocab(spark, VOCAB)
    labels = spark.createDataFrame([(k,) for k in GOLDEN] + [("xyz",), ("a__b_c",)], "label string")
    out = {r["label"]: list(r["tokens"]) for r in tk.tokenize_labels(labels, vocab).collect()}
    for label, tokens in GOLDEN.items():
        assert out[label] == tokens, label
    assert out["xyz"] == ["<unk>"]                 # short and unknown
    assert out["a__b_c"] == ["<unk>", "<unk>", "<unk>", "<unk>"]  # empty parts are unknown


def test_rule_a_ids_match_registry(spark):
    vocab = _vocab(spark, VOCAB)
    ids = {r["token"]: r["id"] for r in vocab.table.collect()}
    assert ids["<pad>"] == 0 and ids["<unk>"] == 1
    labels = spark.createDataFrame([("looking_at_viewer",)], "label string")
    row = tk.tokenize_labels(labels, vocab).collect()[0]
    assert list(row["ids"]) == [ids["looking"], ids["at"], ids["viewer"]]


def test_rule_b_words_and_text(spark):
    general = spark.createDataFrame([(0, "black"), (1, "hair"), (2, "long-hair")],
                                    "rank long, token string")
    labels = spark.createDataFrame([], "rank long, token string")
    vocab = tk.materialize_vocab(vb.registry_b(spark, labels, general, extra_ids=2),
                                 PAD_TOKEN, UNK_TOKEN, "</s>")
    ids = {r["token"]: r["id"] for r in vocab.table.collect()}
    assert [ids[t] for t in ("<pad>", "</s>", "<unk>")] == [0, 1, 2]
    assert ids["<extra_id_0>"] == 6 and ids["<extra_id_1>"] == 7
    docs = spark.createDataFrame([(1, "Black_Hair long-hair x-y  hair")], "doc_id long, text string")
    row = tk.tokenize_text(docs, vocab).collect()[0]
    # black_hair -> split; long-hair whole; x-y short -> unk; '' -> unk; hair whole
    assert list(row["tokens"]) == ["black", "hair", "long-hair", "<unk>", "<unk>", "hair"]


def test_decode_ids_roundtrip(spark):
    vocab = _vocab(spark, VOCAB)
    labels = spark.createDataFrame([("orange_(fruit)_(meme)",)], "label string")
    table = tk.tokenize_labels(labels, vocab)
    dec = tk.decode_ids(table, ["label"], "ids", vocab).collect()[0]
    assert list(dec["decoded"]) == ["orange", "fruit", "meme"]
