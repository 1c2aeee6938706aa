"""Functions of text and labels on columns of the tables: texts of the domain are made of each row's own values, and the SQL says the rule anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import categories as CT, display as D, labelling as LB, sentiment as SE, text as TX
from .registry import query
from .standins import table

_list = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


@query("""
WITH r AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN '爆' WHEN 1 THEN 'XX' WHEN 2 THEN 'X' || p_size WHEN 3 THEN 'X' WHEN 4 THEN '' WHEN 5 THEN ' ' || p_size || ' ' WHEN 6 THEN '-' || p_size WHEN 7 THEN p_name ELSE '+' || p_partkey END AS raw FROM part)
SELECT p_partkey, raw, CASE WHEN trim(raw) = '' THEN 0 WHEN raw = '爆' THEN 100 WHEN raw = 'XX' THEN -10 WHEN raw = 'X' THEN -1 WHEN regexp_full_match(raw, 'X[0-9]+') THEN -CAST(raw[2:] AS INTEGER) WHEN regexp_full_match(trim(raw), '[+-]?[0-9]+') THEN CAST(trim(raw) AS INTEGER) END AS push_count FROM r
""")
def push_count_parse(spark, sf_dir):
    k, n = F.col("p_partkey") % 9, F.col("p_size").cast("string")
    raw = F.when(k == 0, "爆").when(k == 1, "XX").when(k == 2, F.concat(F.lit("X"), n)).when(k == 3, "X").when(k == 4, "").when(k == 5, F.concat(F.lit(" "), n, F.lit(" "))).when(k == 6, F.concat(F.lit("-"), n)).when(k == 7, F.col("p_name")).otherwise(F.concat(F.lit("+"), F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).withColumn("push_count", TX.push_count(F.col("raw")).cast("int"))


@query("""
WITH r AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_size || '/10' WHEN 1 THEN 'a ' || p_size || ' / 5' WHEN 2 THEN repeat('★', p_size % 7) || '☆' WHEN 3 THEN p_size || '分' WHEN 4 THEN CAST(p_size AS VARCHAR) WHEN 5 THEN (p_size // 5) || '.5分 好' ELSE p_name END AS raw FROM part),
v AS (SELECT *, regexp_extract(raw, '([0-9]+(\\.[0-9]+)?)\\s*/\\s*10', 1) AS ten, regexp_extract(raw, '([0-9]+(\\.[0-9]+)?)\\s*/\\s*5', 1) AS five, length(raw) - length(replace(raw, '★', '')) AS stars, regexp_extract(raw, '[0-9]+(\\.[0-9]+)?') AS num FROM r)
SELECT p_partkey, raw, CASE WHEN ten <> '' THEN least(100, ten::DOUBLE * 10) WHEN five <> '' THEN least(100, five::DOUBLE * 20) WHEN stars > 0 THEN least(100, stars * 20.0) WHEN num <> '' THEN least(100, CASE WHEN num::DOUBLE <= 10 AND contains(raw, '分') THEN num::DOUBLE * 10 ELSE num::DOUBLE END) END::DOUBLE AS author_score FROM v
""")
def author_score_parse(spark, sf_dir):
    k, n = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(n, F.lit("/10"))).when(k == 1, F.concat(F.lit("a "), n, F.lit(" / 5"))).when(k == 2, F.concat(F.repeat(F.lit("★"), (F.col("p_size") % 7).cast("int")), F.lit("☆"))).when(k == 3, F.concat(n, F.lit("分"))).when(k == 4, n)
    raw = raw.when(k == 5, F.concat(F.floor(F.col("p_size") / 5).cast("string"), F.lit(".5分 好"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).withColumn("author_score", TX.author_score(F.col("raw")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400) END AS at FROM orders")
def board_time_parse(spark, sf_dir):
    """Times of orders written as a board does, then read back; some are no times."""
    k = F.col("o_orderkey")
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k % 86400)
    raw = F.when(k % 5 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(k % 5 == 1, F.date_format(at, "EEE MMM dd HH:mm:ss yyyy")).when(k % 5 < 4, F.date_format(at, "EEE MMM  d HH:mm:ss yyyy")).otherwise(F.date_format(at, "d/M/yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", TX.board_time(raw).cast("timestamp_ntz").alias("at"))


@query("""
WITH e AS (SELECT event_id, strftime(ts, '%m/%d %H:%M') AS raw, date_trunc('minute', ts) - to_days(CAST(event_id % 700 - 350 AS INTEGER)) AS posted FROM events),
s AS (SELECT *, try_cast(year(posted) || '-' || raw[1:2] || '-' || raw[4:5] || ' ' || raw[7:11] || ':00' AS TIMESTAMP) AS same, try_cast((year(posted) + 1) || '-' || raw[1:2] || '-' || raw[4:5] || ' ' || raw[7:11] || ':00' AS TIMESTAMP) AS next, try_cast((year(posted) - 1) || '-' || raw[1:2] || '-' || raw[4:5] || ' ' || raw[7:11] || ':00' AS TIMESTAMP) AS last FROM e)
SELECT event_id, raw, CASE WHEN same IS NULL THEN NULL WHEN epoch(same - posted) / 86400 < -180 THEN next WHEN epoch(same - posted) / 86400 > 180 THEN last ELSE same END AS at FROM s
""")
def comment_time_parse(spark, sf_dir):
    """Times of events as comments write them, without the year, under posts of up to a year before or after."""
    at = F.col("ts").cast("timestamp")
    posted = F.timestamp_seconds(F.unix_seconds(F.date_trunc("minute", at)) - (F.col("event_id") % 700 - 350) * 86400)
    raw = F.date_format(at, "MM/dd HH:mm")
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"), TX.comment_time(raw, posted).cast("timestamp_ntz").alias("at"))


REMARKS = ["", "我家附近買不到", "謝謝你的分享", "原來這麼難吃", "果然我吃過就難吃", "業配吧", "茶葉蛋 葉配", "專業推文", "!!!", "😀☀", "所以很貴", "缺貨了 "]


@query(f"""
WITH r AS (SELECT conv_id, turn, {_list(REMARKS)}[(conv_id * 3 + turn) % {len(REMARKS)} + 1] || CASE WHEN turn % 2 = 0 THEN coalesce(text, '') ELSE '' END AS t FROM conversations)
SELECT conv_id, turn, regexp_matches(t, '{TX.OFF_TOPIC}') AS off_topic, regexp_matches(t, '{TX.ECHO}') AND NOT regexp_matches(t, '{TX.FIRST_HAND}') AS echo,
  (contains(t, '業配') OR contains(t, '葉配')) AND NOT (contains(t, '茶葉') OR contains(t, '葉子') OR contains(t, '樹葉') OR contains(t, '葉菜') OR contains(t, '葉片')) AS shill,
  NOT regexp_matches(regexp_replace(t, '[\\x{{1F000}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]', '', 'g'), '[\\x{{3400}}-\\x{{9fff}}A-Za-z0-9]') AS noise FROM r
""")
def remark_marks(spark, sf_dir):
    """Turns with remarks of the domain in front, every other one such a remark alone."""
    from ..functions import cleaners as CL

    t = F.concat(_pick(REMARKS, F.col("conv_id") * 3 + F.col("turn")), F.when(F.col("turn") % 2 == 0, F.coalesce("text", F.lit(""))).otherwise(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"))
    return rows.select("conv_id", "turn", TX.off_topic(F.col("t")).alias("off_topic"), TX.echo(F.col("t")).alias("echo"), TX.shill(F.col("t")).alias("shill"), CL.structural_noise(F.col("t")).alias("noise"))


@query(f"""
WITH c AS (SELECT source AS product, doc_id % 13 <> 0 AS counted, coalesce(text, '') || {_list(REMARKS)}[doc_id % {len(REMARKS)} + 1] AS t, doc_id FROM documents),
s AS (SELECT *, (contains(t, '業配') OR contains(t, '葉配')) AND NOT (contains(t, '茶葉') OR contains(t, '葉子') OR contains(t, '樹葉') OR contains(t, '葉菜') OR contains(t, '葉片')) AS shill FROM c)
SELECT product, CAST(count(*) FILTER (counted) AS BIGINT) AS n_comments, round(CASE WHEN count(*) FILTER (counted) >= 3 THEN count(*) FILTER (counted AND shill) / count(*) FILTER (counted) ELSE 0 END, 6) AS shill_ratio,
  CASE WHEN count(*) FILTER (counted) >= 3 THEN count(*) FILTER (counted AND shill) / count(*) FILTER (counted) ELSE 0 END >= 0.25 AS shill_flag FROM s GROUP BY 1
""")
def shill_share(spark, sf_dir):
    """The library's own words of paid praise, in texts that end with a remark of the domain."""
    from ..operators.publish import shill_stats

    t = F.concat(F.coalesce("text", F.lit("")), _pick(REMARKS, F.col("doc_id")))
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("product"), (F.col("doc_id") % 13 != 0).alias("counted"), TX.shill(t).alias("shill"))
    return shill_stats(rows).withColumn("shill_ratio", F.round("shill_ratio", 6))


SAID = ["", "不", "超", "沒有", "有點", "很", "稍微不", "太", "真的是個", "xxxxx"]
WORDS = [*SE.POSITIVE, *SE.NEGATIVE, *[c for cs in SE.COMPOUNDS.values() for c in cs]]


@query(f"""
WITH l(word, value) AS (VALUES {', '.join(f"('{w}', {v})" for w, v in {**SE.POSITIVE, **SE.NEGATIVE}.items())}), c(word, whole, at_) AS (VALUES {', '.join(f"('{w}', '{c}', {c.index(w)})" for w, cs in SE.COMPOUNDS.items() for c in cs)}),
t AS (SELECT p_partkey, ['推', '噓', '→', ' 推'][p_partkey % 4 + 1] AS tag, {_list(SAID)}[p_partkey % {len(SAID)} + 1] || {_list(WORDS)}[p_partkey % {len(WORDS)} + 1] || ' ' || {_list(SAID)}[(p_partkey // 7) % {len(SAID)} + 1] || {_list(WORDS)}[(p_partkey // 3) % {len(WORDS)} + 1] || p_name AS text FROM part),
p AS (SELECT p_partkey, trim(text) AS text, unnest(range(1, length(trim(text)) + 1)) AS p FROM t),
h AS (SELECT p_partkey, value, CASE WHEN p > 1 THEN substr(text, CAST(greatest(1, p - 4) AS BIGINT), CAST(least(4, p - 1) AS BIGINT)) ELSE '' END AS b FROM p JOIN l ON substr(text, p, length(word)) = word WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.word = l.word AND p - at_ >= 1 AND substr(text, p - at_, length(whole)) = whole)),
w AS (SELECT p_partkey, greatest(-1.0, least(1.0, CAST(value AS DOUBLE) * CASE WHEN regexp_matches(b, '不|沒|無|別') THEN -1 ELSE 1 END * greatest(1.0, {', '.join(f"CASE WHEN contains(b, '{k}') THEN {f} ELSE 1.0 END" for k, f in SE.INTENSIFIERS.items())})::DOUBLE)) AS x FROM h),
s AS (SELECT p_partkey, greatest(-1.0, least(1.0, avg(x))) AS score FROM w GROUP BY 1)
SELECT p_partkey, text, round(greatest(-1.0, least(1.0, 0.6::DOUBLE * CASE WHEN trim(tag) = '推' THEN 1 WHEN tag = '噓' THEN -1 ELSE 0 END + 0.4::DOUBLE * coalesce(score, 0))), 3) AS sentiment FROM t LEFT JOIN s USING (p_partkey)
""")
def lexicon_scores(spark, sf_dir):
    """Two words of the lexicon or compounds that hold one, each behind a negation, an intensifier or neither."""
    k = F.col("p_partkey")
    text = F.concat(_pick(SAID, k), _pick(WORDS, k), F.lit(" "), _pick(SAID, F.floor(k / 7)), _pick(WORDS, F.floor(k / 3)), F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", _pick(["推", "噓", "→", " 推"], k).alias("tag"), text.alias("text"))
    return rows.select("p_partkey", "text", F.round(SE.comment_score(F.col("tag"), F.col("text")), 3).alias("sentiment"))


BRANDS, CONSENSUS = ["7-11", "全家", "某店", "OK", "萊爾富", "其他", "美聯社"], ["一致好評", "評價兩極", "資料不足", "一致負評", "褒貶不一"]


@query(f"""
WITH r AS (SELECT p_partkey AS k, {_list(BRANDS)}[p_partkey % 7 + 1] AS brand, {_list([*CT.CATEGORIES, ' 乳品 ', '車'])}[p_partkey % 13 + 1] AS category, ['高', '中', '低'][p_partkey % 3 + 1] AS conf, {_list(CONSENSUS)}[p_partkey % 5 + 1] AS cons, p_size % 4 AS n, CASE WHEN p_size % 6 > 0 THEN p_size * 2 END AS score, p_size AS a, p_size % 7 AS b, p_partkey % 5 AS c FROM part),
v AS (SELECT *, CASE WHEN brand = '某店' THEN '其他' ELSE brand END AS shown, CASE WHEN cons = '資料不足' THEN '不足' WHEN conf = '高' AND n < 2 THEN '中等' WHEN conf = '高' THEN '充足' WHEN conf = '中' THEN '中等' ELSE '不足' END AS level FROM r)
SELECT k AS p_partkey, shown AS shown_brand, CAST(list_position(['7-11', '全家', '萊爾富', 'OK', '美聯社', '其他'], shown) - 1 AS INTEGER) AS brand_rank, CASE WHEN trim(category) IN ('便當', '鹹食', '泡麵') THEN '正餐' WHEN trim(category) IN ('飲料', '乳品') THEN '飲料' WHEN trim(category) IN ('甜點', '冰品', '麵包', '零食') THEN trim(category) ELSE '其他' END AS category_group,
  level AS volume, CASE level WHEN '充足' THEN 78 WHEN '中等' THEN 52 ELSE 28 END AS percent, CASE WHEN cons = '一致好評' THEN 'good' WHEN cons IN ('評價兩極', '褒貶不一') THEN 'mixed' ELSE 'low' END AS tone, CASE WHEN score IS NULL THEN 'none' WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'middle' ELSE 'low' END AS score_tone,
  CASE WHEN conf = '高' AND n < 2 THEN '中' ELSE conf END AS shown_confidence, CASE WHEN conf = '低' OR cons = '資料不足' THEN '資料仍少，排名已降權，請保守解讀' WHEN conf = '中' THEN '樣本量中等，可作為初步參考' ELSE '樣本量較充足' END AS note,
  CASE WHEN conf <> '低' AND a + b + c > 0 THEN '正評' || CAST(floor(a / (a + b + c) * 100 + 0.5) AS INTEGER) || ' 中立' || CAST(floor(b / (a + b + c) * 100 + 0.5) AS INTEGER) || ' 負評' || CAST(floor(c / (a + b + c) * 100 + 0.5) AS INTEGER) ELSE '' END AS segments,
  CASE WHEN n > 0 THEN '競品提及: ' || n || ' 則，其中 ' || b || ' 則偏好他牌；競品: ' || CASE WHEN c > 0 THEN brand || '、OK' ELSE '未辨識' END ELSE '' END AS competitors FROM v
""")
def shelf_view(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        k, _pick(BRANDS, k).alias("brand"), _pick([*CT.CATEGORIES, " 乳品 ", "車"], k).alias("category"), _pick(["高", "中", "低"], k).alias("conf"), _pick(CONSENSUS, k).alias("cons"), (size % 4).alias("n"), F.when(size % 6 > 0, size * 2).alias("score"),
        size.alias("a"), (size % 7).alias("b"), (k % 5).alias("c"),
    )
    level = D.volume_level(F.col("conf"), F.col("cons"), F.col("n"))
    named = F.when(F.col("c") > 0, F.array(F.col("brand"), F.lit("OK"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "p_partkey", D.display_brand(F.col("brand")).alias("shown_brand"), D.brand_rank(F.col("brand")).alias("brand_rank"), D.display_category(F.col("category")).alias("category_group"), level.alias("volume"), D.volume_percent(level).alias("percent"),
        D.consensus_tone(F.col("cons")).alias("tone"), D.score_tone(F.col("score")).alias("score_tone"), D.display_confidence(F.col("conf"), F.col("n")).alias("shown_confidence"), D.evidence_note(F.col("conf"), F.col("cons")).alias("note"),
        F.array_join(F.transform(D.sentiment_segments(F.col("conf"), F.col("a"), F.col("b"), F.col("c")), lambda s: F.concat(s["label"], s["value"].cast("string"))), " ").alias("segments"), D.competitor_line(F.col("n"), F.col("b"), named).alias("competitors"),
    )


@query("""
WITH r AS (SELECT o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS t_, ['1w', '2w', '1m', '3m', 'all'][o_orderkey % 5 + 1] AS preset FROM orders)
SELECT k AS o_orderkey, round(epoch(TIMESTAMP '2001-08-01 06:00:00' - t_) / 86400, 6) AS age, epoch(TIMESTAMP '2001-08-01 06:00:00' - t_) / 86400 > 14 AS stale, strftime(t_ + INTERVAL 8 HOURS, '%Y/%m/%d') AS shown, CAST(datediff('day', DATE '1992-01-01', t_::DATE) AS INTEGER) AS first_offset,
  CAST(DATE '1992-01-01' + CAST(k % 3000 AS INTEGER) AS DATE) AS day, CASE preset WHEN '1w' THEN t_::DATE - 7 WHEN '2w' THEN t_::DATE - 14 WHEN '1m' THEN CAST(t_::DATE - INTERVAL 1 MONTH AS DATE) WHEN '3m' THEN CAST(t_::DATE - INTERVAL 3 MONTH AS DATE) END AS starts,
  CASE WHEN k % 2 = 0 THEN '' ELSE 'a' END AS from_date, CASE WHEN k % 2 = 0 THEN '' ELSE 'z' END AS to_date FROM r
""")
def freshness_of_orders(spark, sf_dir):
    k = F.col("o_orderkey")
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k % 24 * 3600)
    rows = table(spark, sf_dir, "orders").select(k, at.alias("at"), _pick(["1w", "2w", "1m", "3m", "all"], k).alias("preset"))
    now, first = F.lit("2001-08-01 06:00:00").cast("timestamp"), F.lit("1992-01-01")
    span = D.normal_range(F.when(k % 2 == 0, "b").otherwise("a"), F.lit("z"), F.lit("b"), F.lit("z"))
    return rows.select(
        "o_orderkey", F.round(D.age_days(F.col("at"), now), 6).alias("age"), D.is_stale(F.col("at"), now).alias("stale"), D.display_date(F.col("at")).alias("shown"), D.date_offset(F.col("at"), first).alias("first_offset"),
        D.offset_date((k % 3000).cast("int"), first).alias("day"), D.preset_start(F.col("preset"), F.to_date("at")).alias("starts"), span["from_date"].alias("from_date"), span["to_date"].alias("to_date"),
    )


FORMS = [*LB.SENTIMENTS, *LB.BOOLEANS, *LB.FAVOURED, "好", "maybe"]


@query(f"""
WITH s(form, label) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in LB.SENTIMENTS.items())}), b(form, label) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in LB.BOOLEANS.items())}), f(form, label) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in LB.FAVOURED.items())}),
r AS (SELECT doc_id, {_list(FORMS)}[doc_id % {len(FORMS)} + 1] AS form FROM labels)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ' ' || upper(r.form) ELSE r.form END AS raw, s.label AS sentiment, b.label AS flag, f.label AS favoured, CASE WHEN r.form IN ('本牌', 'own', 'post') THEN 'own' WHEN r.form IN ('無', 'none', 'unknown', '') THEN 'none' ELSE 'other' END AS target
FROM r LEFT JOIN s ON r.form = s.form LEFT JOIN b ON r.form = b.form LEFT JOIN f ON r.form = f.form
""")
def label_forms(spark, sf_dir):
    """Every form a label may have, by the labelled document's key, some in capitals with white space."""
    form = _pick(FORMS, F.col("doc_id"))
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.upper(form))).otherwise(form)
    rows = table(spark, sf_dir, "labels").select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", "raw", LB.sentiment_label(F.col("raw"), strict=False).alias("sentiment"), LB.boolean_label(F.col("raw"), strict=False).alias("flag"), LB.favoured_label(F.col("raw"), strict=False).alias("favoured"), LB.target_label(F.col("raw")).alias("target"))


TIMES_SQL = """
WITH r AS (SELECT o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400) AS clock FROM orders)
SELECT k AS o_orderkey, CASE k % 9 WHEN 0 THEN date_trunc('day', clock) - INTERVAL 8 HOURS WHEN 1 THEN date_trunc('day', clock) - INTERVAL 8 HOURS WHEN 2 THEN date_trunc('day', clock) - INTERVAL 8 HOURS WHEN 3 THEN clock - INTERVAL 8 HOURS WHEN 4 THEN clock WHEN 5 THEN clock + INTERVAL 210 MINUTES WHEN 6 THEN date_trunc('minute', clock) - INTERVAL 8 HOURS WHEN 7 THEN NULL ELSE clock - INTERVAL 8 HOURS + INTERVAL 250 MILLISECONDS END AS at,
  CASE WHEN k % 9 < 3 THEN date_trunc('day', clock) + INTERVAL 16 HOURS - INTERVAL 1 MICROSECOND END AS until FROM r
"""


@query(TIMES_SQL)
def strict_times(spark, sf_dir):
    """Times of orders in every form that is read: days, clocks with and without zone, blanks."""
    from ..functions import times as TM

    k = F.col("o_orderkey")
    clock = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k % 86400)
    says = lambda form: F.date_format(clock, form)
    raw = F.when(k % 9 == 0, says("yyyy-MM-dd")).when(k % 9 == 1, says("yyyy/M/d")).when(k % 9 == 2, says("yyyyMMdd")).when(k % 9 == 3, says("yyyy-MM-dd HH:mm:ss")).when(k % 9 == 4, says("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 9 == 5, says("yyyy-MM-dd HH:mm:ss'-0330'"))
    raw = raw.when(k % 9 == 6, says("yyyy-MM-dd'T'HH:mm")).when(k % 9 == 7, " ").otherwise(F.concat(says("yyyy-MM-dd HH:mm:ss"), F.lit(".25+08:00")))
    return table(spark, sf_dir, "orders").select("o_orderkey", TM.in_zone(TM.read_time(raw), "UTC").alias("at"), F.when(k % 9 < 3, TM.in_zone(TM.read_time(raw, end_of_day=True), "UTC")).alias("until"))
