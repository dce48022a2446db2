"""SQL building blocks of the DuckDB twins.

The corpus CTEs derive ``files`` / ``tags`` / ``frame_counts`` from the driver
tables with the same expressions as ``tagweave.sources.tables``. They are an
independent formulation (plain SQL, UNION ALL instead of a generator) so a
mistake on one side shows up as a mismatch.
"""

from __future__ import annotations

CORPUS_CTES = """
files AS (
  SELECT o_orderpriority AS booru,
         o_orderkey AS fid,
         CASE WHEN o_orderkey % 10 < 5 THEN '2021' ELSE '2022' END AS shard,
         CAST(o_orderkey AS VARCHAR) || '.png' AS file_name,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE md5(CAST(o_orderkey AS VARCHAR)) END AS torr_md5
  FROM orders
),
tag_src AS (
  SELECT o.o_orderpriority AS booru, l.l_orderkey AS fid,
         p.p_name, p.p_type, p.p_brand, p.p_size, s.s_name, n.n_name
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
),
tags AS (
  SELECT DISTINCT booru, fid, tag, CAST(NULL AS BIGINT) AS tag_id, tag_cat,
         CAST(NULL AS VARCHAR) AS danb_fr
  FROM (
    SELECT booru, fid, replace(p_name, ' ', '_') AS tag, 0 AS tag_cat FROM tag_src
    UNION ALL SELECT booru, fid, p_type, 0 FROM tag_src
    UNION ALL SELECT booru, fid, replace(p_name, ' ', '_') || '_(' || lower(p_type) || ')', 0
              FROM tag_src WHERE p_size % 5 = 0
    UNION ALL SELECT booru, fid, lower(n_name) || '_(cosplay)', 0 FROM tag_src WHERE p_size % 7 = 0
    UNION ALL SELECT booru, fid, '=_=', 0 FROM tag_src WHERE p_size % 11 = 0
    UNION ALL SELECT booru, fid, lower(p_brand), 1 FROM tag_src
    UNION ALL SELECT booru, fid, lower(n_name), 3 FROM tag_src
    UNION ALL SELECT booru, fid, lower(s_name), 4 FROM tag_src
  ) t
),
frame_counts AS (
  SELECT o.o_orderpriority AS booru, l.l_orderkey AS fid, CAST(sum(l.l_quantity) AS INTEGER) AS frames
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_orderpriority, l.l_orderkey
)
"""


def with_corpus(*ctes: str, body: str) -> str:
    """``WITH <corpus>, <ctes...> <body>``."""
    parts = [CORPUS_CTES.strip()] + [c.strip() for c in ctes if c.strip()]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


ASCII_LOWER = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def ascii_lower_sql(c: str) -> str:
    return ASCII_LOWER.format(c=c)
