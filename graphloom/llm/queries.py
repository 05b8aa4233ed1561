"""The registered queries of the corpus operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.decontaminate import contaminated
from graphloom.llm.extract import main_texts
from graphloom.llm.imatch import fingerprints
from graphloom.llm.licenses import license_scan
from graphloom.llm.mixing import mix
from graphloom.llm.neardup import near_duplicates
from graphloom.llm.pii import personal_data
from graphloom.llm.quality import scored
from graphloom.llm.quotes import threads
from graphloom.llm.sharding import balanced_shards
from graphloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[f.__name__] = f
    return f


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return personal_data(table(spark, sf_dir, "documents"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of the conversations in reply order, without quotes."""
    return threads(table(spark, sf_dir, "conversations"))


@query
def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return balanced_shards(table(spark, sf_dir, "documents"))


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in the documents."""
    return license_scan(table(spark, sf_dir, "documents"))


@query
def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_texts(table(spark, sf_dir, "pages")).drop("host")


@query
def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))


@query
def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document gives to the mix."""
    return mix(table(spark, sf_dir, "documents"))


ORACLES["op5_neardup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS met FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * pairs.met >= 75 * (a.n + b.n - pairs.met)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM documents JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""

ORACLES["op10_mix"] = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('20240607:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM documents),
k AS (SELECT *, CAST(length(bin(size)) AS INTEGER) AS class FROM s),
r AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM s GROUP BY source),
w AS (SELECT *, (no - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM r),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER a, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER a, 0) AS DOUBLE) AS level FROM w WINDOW a AS (ORDER BY CAST(cap AS DOUBLE) / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM l WHERE level * weight <= cap ORDER BY CAST(cap AS DOUBLE) / weight, no LIMIT 1),
t AS (SELECT source, no, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM f), 0) * weight) AS target FROM w),
c AS (SELECT source, class, sum(size) AS words FROM k GROUP BY source, class),
g AS (SELECT no, class, words, target, source_size, coalesce(sum(words) OVER longer, 0) AS above, sum(class * words) OVER (PARTITION BY no) - coalesce(sum(class * words) OVER longer, 0) AS weighed
    FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WINDOW longer AS (PARTITION BY no ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, CASE WHEN weighed > 0 THEN (target - CAST(3 * above AS DOUBLE)) / CAST(weighed AS DOUBLE) ELSE 0 END AS rate FROM g),
m AS (SELECT no, arg_max(rate, class) AS rate FROM h WHERE rate * class <= 3 GROUP BY no),
e AS (SELECT h.no, class, words, target, CASE WHEN target >= source_size * 3 THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, coalesce(m.rate, 3.0::DOUBLE) * class) END AS each FROM h LEFT JOIN m USING (no)),
o AS (SELECT no, target - CAST(sum(CAST(floor(each) AS BIGINT) * words) AS DOUBLE) AS lacking FROM e GROUP BY no, target),
d AS (SELECT k.*, t.no, source_size, t.target, lacking, floor(each) AS whole, each - floor(each) AS p FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source JOIN e ON e.no = t.no AND e.class = k.class JOIN o ON o.no = t.no),
q AS (SELECT *, u / (1 - u) / (p / (1 - p)) AS rank FROM d),
b AS (SELECT *, coalesce(sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY no ORDER BY p = 0, rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM q),
x AS (SELECT no, max(struct_pack(rank := rank, doc_id := doc_id, size := size)) AS last FROM b WHERE p > 0 AND 2 * ahead + size <= 2 * lacking GROUP BY no),
z AS (SELECT b.*, CAST(whole AS INTEGER) + CASE WHEN p > 0 AND coalesce(struct_pack(rank := rank, doc_id := doc_id, size := size) <= last, false) THEN 1 ELSE 0 END AS copies FROM b LEFT JOIN x USING (no))
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies, p FROM z
"""
