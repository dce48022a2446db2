"""Raw TSV shard ingest: header, quote rule, WxH, duplicates."""

import os

from tagweave.sources import tsv
from tagweave.sources.datasets import load_by_extension, read_token_list, text_column

HEADER_F = "\t".join(tsv.RAW_FILES_COLUMNS)
HEADER_T = "\t".join(tsv.RAW_TAGS_COLUMNS)


def _write(path, lines):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_files_ingest(spark, tmp_dir):
    p = os.path.join(tmp_dir, "files.tsv")
    _write(p, [HEADER_F,
               "b\t1\tf1.png\tabc\tjpg\t\t100\t640x480\t95\tp\tc1\tch\tar",
               "b\t2\tf2.png\t\tpng\t\t\t12x\t\t\t\t\t",
               'b\t3\t"quoted".png\t\tpng\t\t\tx\t\t\t\t\t',
               "b\t4\tf4.png\t\tpng\t\tabc\tabcxdef\t\t\t\t\t"])
    rows = {r["fid"]: r for r in tsv.ingest_files(spark, [("S 2021a", p)]).collect()}
    assert sorted(rows) == [1, 2, 4]                     # quoted line dropped, header skipped
    assert (rows[1]["img_width_torr"], rows[1]["img_height_torr"]) == (640, 480)
    assert (rows[2]["img_width_torr"], rows[2]["img_height_torr"]) == (12, 0)
    assert (rows[4]["img_width_torr"], rows[4]["img_height_torr"]) == (0, 0)
    assert rows[1]["shard"] == "S 2021a" and rows[2]["torr_md5"] == ""
    assert rows[4]["file_size"] is None and rows[1]["file_size"] == 100


def test_tags_ingest_dedup_and_quotes(spark, tmp_dir):
    p = os.path.join(tmp_dir, "tags.tsv")
    _write(p, [HEADER_T,
               "chan\t25521675\tgenshin_impact\t1528497\t3\tgenshin_impact",
               "chan\t25521675\tgenshin_impact\t1528497\t3\tgenshin_impact",
               "chan\t25521675\tzhongli_(genshin_impact)\t1600114\t4\tgenshin_impact",
               "chan\t25521675\tzhongli_(genshin_impact)\t1600114\t4\tgenshin_impact",
               'zero\t3633380\t"I\'m_One_Dapping_Fella"_S...\t0\t3\tCOPYRIGHT'])
    rows = tsv.ingest_tags(spark, [p]).collect()
    assert sorted(r["tag"] for r in rows) == ["genshin_impact", "zhongli_(genshin_impact)"]
    assert {r["tag_cat"] for r in rows} == {3, 4}


def test_loaders_and_token_list(spark, tmp_dir):
    p = os.path.join(tmp_dir, "corpus.txt")
    _write(p, ["first line", "second line"])
    df = load_by_extension(spark, p)
    assert text_column(df) == "text" and df.count() == 2
    t = os.path.join(tmp_dir, "tokens.tsv")
    _write(t, ["c", "", "a", "b"])
    got = [(r["rank"], r["token"]) for r in read_token_list(spark, t).orderBy("rank").collect()]
    assert got == [(0, "c"), (1, "a"), (2, "b")]
