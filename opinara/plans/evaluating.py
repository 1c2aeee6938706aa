"""Queries on evaluation by slices: comments as gold rows, with labels that a backend meets or misses."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import evaluation as EV
from .registry import query
from .standins import table

#: A comment of a post of 全家 by ``k % 8``; what the rules and the tag alone say of it: sentiment, target, favoured, comparative.
SAID = [
    ("推", "好吃推薦", "positive", "positive", "own", "unknown", "false"), ("噓", "難吃又貴", "negative", "negative", "own", "unknown", "false"), ("→", "餅乾", "neutral", "neutral", "own", "unknown", "false"), ("→", "", "neutral", "neutral", "none", "unknown", "false"),
    ("→", "比小7好吃", "positive", "neutral", "own", "own", "true"), ("推", "小7的比較好吃", "positive", "positive", "other", "other", "true"), ("→", "小7也有賣", "neutral", "neutral", "other", "unknown", "false"), ("噓", "輸小7", "negative", "negative", "other", "other", "true"),
]
GOLD = {"sentiment": ["正", "負", "中"], "target_brand": ["本牌", "他牌", "無"], "favored_brand": ["本牌", "他牌", ""], "is_comparative": ["是", "否"]}
CUMULATIVE = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(7)]
_arr = lambda x: "[" + ", ".join(f"'{v}'" for v in x) + "]"


def gold(spark, sf_dir):
    k = F.col("doc_id")
    pick = lambda xs, at: F.element_at(F.array(*[F.lit(x) for x in xs]), (at % len(xs) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.lit("全家").alias("post_brand"), pick([s[0] for s in SAID], k).alias("comment_tag"), pick([s[1] for s in SAID], k).alias("comment_text"),
        *[pick(v, F.floor(k / (8 * (i + 1)))).alias(c) for i, (c, v) in enumerate(GOLD.items())],
    )


GOLD_SQL = f"""
g AS (SELECT doc_id, lang, doc_id % 8 AS c, ['positive', 'negative', 'neutral'][doc_id // 8 % 3 + 1] AS g1, ['own', 'other', 'none'][doc_id // 16 % 3 + 1] AS g2, ['own', 'other', 'unknown'][doc_id // 24 % 3 + 1] AS g3, ['true', 'false'][doc_id // 32 % 2 + 1] AS g4 FROM documents),
p AS (SELECT doc_id, lang, unnest(['lexicon', 'tag']) AS backend, g.* EXCLUDE (doc_id, lang) FROM g),
t AS (SELECT doc_id, lang, backend, unnest(['sentiment', 'target', 'favoured', 'comparative']) AS task, unnest([g1, g2, g3, g4]) AS gold,
  unnest([CASE WHEN backend = 'tag' THEN ['positive', 'negative', 'neutral', 'neutral', 'neutral', 'positive', 'neutral', 'negative'][c + 1] ELSE {_arr(s[2] for s in SAID)}[c + 1] END, {_arr(s[4] for s in SAID)}[c + 1], {_arr(s[5] for s in SAID)}[c + 1], {_arr(s[6] for s in SAID)}[c + 1]]) AS pred FROM p)
"""


@query(f"WITH {GOLD_SQL} SELECT * FROM t")
def evaluation_rows(spark, sf_dir):
    return EV.predictions(gold(spark, sf_dir), ["lexicon", "tag"]).select("doc_id", "lang", "backend", "task", "gold", "pred")


@query(f"""
WITH {GOLD_SQL}, b AS (SELECT t.*, b, CASE WHEN b = 0 THEN -1.0 ELSE ('0x' || substr(md5(doc_id || ':' || b), 1, 8))::UBIGINT / 4294967296.0 END AS u FROM t, range(101) r(b)),
w AS (SELECT *, (gold = pred)::INT AS hit, CASE WHEN b = 0 THEN 1 {' '.join(f'WHEN u < {c!r} THEN {k}' for k, c in enumerate(CUMULATIVE))} ELSE 7 END AS w FROM b),
s AS (SELECT CASE WHEN grouping(lang) = 0 THEN 'task+backend+lang' ELSE 'task+backend' END AS slice, task, backend, lang, b, sum(w) AS n, sum(w * hit) AS k FROM w GROUP BY GROUPING SETS ((task, backend, b), (task, backend, lang, b))),
x AS (SELECT slice, task, backend, lang, max(n) FILTER (b = 0) AS n_rows, max(k / n) FILTER (b = 0) AS accuracy, list_sort(list(k / n) FILTER (b > 0 AND n > 0)) AS x FROM s GROUP BY ALL)
SELECT slice, task, backend, lang, CAST(n_rows AS BIGINT) AS n_rows, round(accuracy, 4) AS accuracy, round(x[greatest(1, ceil(len(x) * ((1 - 0.95) / 2))::INT)], 4) AS low, round(x[greatest(1, ceil(len(x) * ((1 + 0.95) / 2))::INT)], 4) AS high, accuracy >= 0.8 AS meets_target, n_rows < 30 AS small_sample FROM x
""")
def sliced_evaluation(spark, sf_dir):
    return EV.sliced_accuracy(EV.predictions(gold(spark, sf_dir), ["lexicon", "tag"]), [["task", "backend"], ["task", "backend", "lang"]], "doc_id", replicates=100)
