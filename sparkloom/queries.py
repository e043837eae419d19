"""The catalogue of queries over the test tables, each with DuckDB SQL for the same result.

The tables hold no nulls and no dirty text. Both engines derive such inputs from the keys by the same expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .arrow import map_arrow
from .functions import normalize as N
from .functions import predicates as P
from .operators import dedup, impute, outliers, profile, search, sketches, validate
from .operators.gram_index import GramIndex
from .pipeline import clean
from .plans.cleaning import default_plan, index_mapping, normalize_table
from .plans.names import ONTOLOGY, match_name
from .schemas import ColumnPlan, Impute, Outlier, TablePlan
from .schemas import SemanticType as T
from .sources import readers, sinks
from .sources.scratch import cut, shared_path
from .streaming.clean_stream import clean_stream, drop_repeats, fill_forward, fill_stream, fitted_fills

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Expressions that both engines read alike.
PHONE = """CASE c_custkey % 8 WHEN 0 THEN '0300' || lpad(cast(c_custkey AS string), 7, '0') WHEN 1 THEN '+92 321 ' || lpad(cast(c_custkey AS string), 7, '0')
 WHEN 2 THEN '0092333' || lpad(cast(c_custkey AS string), 7, '0') WHEN 3 THEN '345-' || lpad(cast(c_custkey AS string), 7, '0')
 WHEN 4 THEN '0213555' || lpad(cast(c_custkey % 10000 AS string), 4, '0') WHEN 5 THEN 'n/a' WHEN 6 THEN NULL ELSE '92-301-' || lpad(cast(c_custkey AS string), 7, '0') END"""
CNIC = """CASE c_custkey % 4 WHEN 0 THEN lpad(cast(c_custkey AS string), 13, '3') WHEN 1 THEN '35202-' || lpad(cast(c_custkey AS string), 7, '1') || '-5'
 WHEN 2 THEN ' 4210' || cast(c_custkey AS string) || ' ' ELSE NULL END"""
CLOCK = """CASE event_id % 8 WHEN 0 THEN cast(event_id * 7 AS string) WHEN 1 THEN lpad(cast(event_id % 12 + 1 AS string), 2, '0') || ':05:09 AM'
 WHEN 2 THEN cast(event_id % 12 + 1 AS string) || ':45 pm' WHEN 3 THEN cast(event_id % 30 AS string) || ':07:30' WHEN 4 THEN cast(event_id % 5 AS string) || 'h ' || cast(event_id % 90 AS string) || 'm'
 WHEN 5 THEN cast(event_id % 200 AS string) || ' secs' WHEN 6 THEN 'n/a' ELSE 'soon' END"""
MONEY = """CASE o_orderkey % 5 WHEN 0 THEN 'PKR ' || cast(cast(floor(o_totalprice) AS bigint) AS string) || '.50' WHEN 1 THEN '$' || cast(cast(floor(o_totalprice / 1000) AS bigint) AS string) || ',250'
 WHEN 2 THEN 'Rs. ' || cast(o_orderkey AS string) WHEN 3 THEN 'null' ELSE '-' || cast(o_orderkey AS string) || ' USD' END"""
FLAG = """CASE doc_id % 7 WHEN 0 THEN ' Yes' WHEN 1 THEN 'T' WHEN 2 THEN 'inactive' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' WHEN 5 THEN 'ENABLED ' ELSE NULL END"""
LABEL = """'  ' || p_name || CASE p_partkey % 3 WHEN 0 THEN '   (x) ' WHEN 1 THEN ' o''neil mc-donald' ELSE '' END"""
MIXED = """CASE event_id % 16 WHEN 0 THEN '0300-1234567' WHEN 1 THEN '3520212345671' WHEN 2 THEN '+14155550100' WHEN 3 THEN 'u' || cast(event_id AS string) || '@mail.example'
 WHEN 4 THEN '10:30 PM' WHEN 5 THEN '2024-03-' || lpad(cast(event_id % 28 + 1 AS string), 2, '0') WHEN 6 THEN 'Rs. 500' WHEN 7 THEN '36 %' WHEN 8 THEN '10.0.0.' || cast(event_id % 256 AS string)
 WHEN 9 THEN 'https://x.example/' || cast(event_id AS string) WHEN 10 THEN 'yes' WHEN 11 THEN 'female' WHEN 12 THEN cast(event_id % 100 + 2 AS string) WHEN 13 THEN 'House 5, Canal Road'
 WHEN 14 THEN cast(event_id + 1000 AS string) ELSE 'x' || cast(event_id AS string) END"""
SPIKED = "CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 20 ELSE o_totalprice END"
GAPPY = "CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END"
STATUS = "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END"

_KNOWN = "CASE WHEN trim({0}) = '' OR lower(trim({0})) IN ('nan', 'none', 'null', 'n/a') THEN NULL ELSE trim({0}) END"


@query(
    f"""WITH s AS (SELECT c_custkey, {PHONE} AS raw FROM customer), d AS (SELECT *, regexp_replace({_KNOWN.format("raw")}, '[^0-9]', '', 'g') AS digits FROM s),
b AS (SELECT *, ltrim(digits, '0') AS bare FROM d),
c AS (SELECT *, CASE WHEN length(bare) = 12 AND starts_with(bare, '923') THEN substr(bare, 3)
  WHEN length(bare) >= 10 AND strpos(bare, '3') BETWEEN 1 AND 3 AND length(bare) - strpos(bare, '3') + 1 = 10 THEN substr(bare, strpos(bare, '3')) ELSE bare END AS body FROM b)
SELECT c_custkey, CASE WHEN digits <> '' THEN '92' || body END AS phone, CASE WHEN digits <> '' THEN '+92' || body END AS phone_plus, CASE WHEN digits <> '' THEN '0' || body END AS phone_local,
  CASE WHEN digits <> '' THEN CASE WHEN length(body) = 10 THEN '+92 ' || substr(body, 1, 3) || ' ' || substr(body, 4) ELSE '+92 ' || body END END AS phone_spaced FROM c"""
)
def normalize_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(PHONE)
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        N.clean_phone(raw).alias("phone"),
        N.clean_phone(raw, "+92").alias("phone_plus"),
        N.clean_phone(raw, "03").alias("phone_local"),
        N.clean_phone(raw, "formatted").alias("phone_spaced"),
    )


@query(
    f"""WITH s AS (SELECT c_custkey, {_KNOWN.format("raw")} AS k FROM (SELECT c_custkey, {PHONE} AS raw FROM customer))
SELECT c_custkey, CASE WHEN length(regexp_replace(k, '[^0-9+]', '', 'g')) >= 7 THEN regexp_replace(k, '[^0-9+]', '', 'g') END AS phone FROM s"""
)
def normalize_intl_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", N.clean_intl_phone(F.expr(PHONE)).alias("phone"))


@query(
    f"""WITH s AS (SELECT c_custkey, trim({CNIC}) AS raw FROM customer), d AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM s)
SELECT c_custkey, CASE WHEN length(digits) = 13 THEN substr(digits, 1, 5) || '-' || substr(digits, 6, 7) || '-' || substr(digits, 13) WHEN raw <> '' THEN raw END AS cnic FROM d"""
)
def normalize_cnic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", N.clean_cnic(F.expr(CNIC)).alias("cnic"))


@query(
    f"""WITH s AS (SELECT event_id, {CLOCK} AS raw FROM events), k AS (SELECT event_id, {_KNOWN.format("raw")} AS v FROM s),
g AS (SELECT *, regexp_extract(v, '^([0-9]{{1,2}}):([0-9]{{1,2}})(:([0-9]{{1,2}}))? *([apAP])[mM]$', ['h', 'm', 'x', 's', 'p']) AS a,
  regexp_extract(v, '^([0-9]+):([0-9]{{1,2}})(:([0-9]{{1,2}}))?$', ['h', 'm', 'x', 's']) AS b,
  CAST(CASE WHEN regexp_matches(v, '^[0-9]+$') THEN v ELSE NULL END AS bigint) AS n,
  list_sum(list_transform(regexp_extract_all(v, '([0-9]+) *h', 1), lambda x: CAST(x AS bigint))) AS hh,
  list_sum(list_transform(regexp_extract_all(v, '([0-9]+) *m', 1), lambda x: CAST(x AS bigint))) AS mm,
  list_sum(list_transform(regexp_extract_all(v, '([0-9]+) *s', 1), lambda x: CAST(x AS bigint))) AS ss FROM k),
t AS (SELECT *, coalesce(hh, 0) * 3600 + coalesce(mm, 0) * 60 + coalesce(ss, 0) AS total,
  CASE WHEN a.h = '' THEN NULL WHEN lower(a.p) = 'p' AND a.h <> '12' THEN TRY_CAST(a.h AS bigint) + 12 WHEN lower(a.p) = 'a' AND a.h = '12' THEN 0 ELSE TRY_CAST(a.h AS bigint) END AS h12 FROM g),
o AS (SELECT event_id, v, CASE WHEN n IS NOT NULL THEN n // 3600 WHEN a.h <> '' THEN h12 WHEN b.h <> '' THEN TRY_CAST(b.h AS bigint) WHEN regexp_matches(v, '[0-9] *[hms]') THEN CAST(total AS bigint) // 3600 END AS h,
  CASE WHEN n IS NOT NULL THEN n % 3600 // 60 WHEN a.h <> '' THEN TRY_CAST(a.m AS bigint) WHEN b.h <> '' THEN TRY_CAST(b.m AS bigint) ELSE CAST(total AS bigint) % 3600 // 60 END AS m,
  CASE WHEN n IS NOT NULL THEN n % 60 WHEN a.h <> '' THEN coalesce(TRY_CAST(a.s AS bigint), 0) WHEN b.h <> '' THEN coalesce(TRY_CAST(b.s AS bigint), 0) ELSE CAST(total AS bigint) % 60 END AS s FROM t)
SELECT event_id, CASE WHEN h IS NULL THEN v ELSE CAST(h AS string) || ':' || lpad(CAST(m AS string), 2, '0') || ':' || lpad(CAST(s AS string), 2, '0') END AS duration,
  CASE WHEN h IS NULL THEN v ELSE lpad(CAST(h AS string), CAST(greatest(2, length(CAST(h AS string))) AS int), '0') || ':' || lpad(CAST(m AS string), 2, '0') || ':' || lpad(CAST(s AS string), 2, '0') END AS duration_long FROM o"""
)
def normalize_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(CLOCK)
    return table(spark, sf_dir, "events").select("event_id", N.clean_duration(raw).alias("duration"), N.clean_duration(raw, "HH:MM:SS").alias("duration_long"))


@query(
    f"""WITH s AS (SELECT o_orderkey, {MONEY} AS raw FROM orders), k AS (SELECT o_orderkey, {_KNOWN.format("raw")} AS v FROM s)
SELECT o_orderkey, TRY_CAST(regexp_extract(replace(regexp_replace(regexp_replace(v, '(?i)\\b(pkr|rs\\.?|usd|eur|gbp|inr|cents?|dollars?)\\b', '', 'g'), '[$€£¥₹]', '', 'g'), ',', ''),
  '[-+]?[0-9]*\\.?[0-9]+') AS double) AS amount FROM k"""
)
def normalize_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", N.clean_currency(F.expr(MONEY)).alias("amount"))


@query(
    f"""WITH s AS (SELECT doc_id, lower(trim({FLAG})) AS v FROM labels)
SELECT doc_id, CASE WHEN v IN ('true', '1', 'yes', 'y', 't', 'active', 'pass', 'enable', 'enabled') THEN true
  WHEN v IN ('false', '0', 'no', 'n', 'f', 'inactive', 'fail', 'disable', 'disabled') THEN false END AS flag FROM s"""
)
def normalize_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", N.clean_boolean(F.expr(FLAG)).alias("flag"))


@query(
    f"""WITH s AS (SELECT p_partkey, trim(regexp_replace({LABEL}, '\\s+', ' ', 'g')) AS v FROM part)
SELECT p_partkey, v AS plain, lower(v) AS low, upper(v) AS up,
  array_to_string(list_transform(regexp_extract_all(lower(v), '[a-z]+|[^a-z]+'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '') AS title FROM s"""
)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(LABEL)
    return table(spark, sf_dir, "part").select(
        "p_partkey", N.clean_text(raw).alias("plain"), N.clean_text(raw, "lower").alias("low"), N.clean_text(raw, "upper").alias("up"), N.clean_text(raw, "title").alias("title")
    )


@query(
    """WITH s AS (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 6 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN strftime(d, '%Y-%m-%d') || ' 00:00:00' WHEN 1 THEN strftime(d, '%Y-%m-%d') || ' 07:05:09' WHEN 2 THEN strftime(d, '%Y-%m-%d') || ' 00:00:00'
  WHEN 3 THEN strftime(d, '%Y-%m-%d %H:%M:%S') WHEN 4 THEN strftime(d, '%Y-%m-%d %H:%M:%S') END AS ts FROM s"""
)
def normalize_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    seconds = F.unix_timestamp(d.cast("timestamp"))
    text = F.date_format(d, "yyyy-MM-dd HH:mm:ss")
    # Seconds before September 2001 have nine digits, which nothing tells from a plain number.
    epoch = lambda zeros: F.when(seconds >= 10**9, F.concat(seconds.cast("string"), F.lit(zeros))).otherwise(text)
    shapes = (
        F.date_format(d, "yyyy/MM/dd"),
        F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T07:05:09Z")),
        F.date_format(d, "MM/dd/yyyy"),
        epoch(""),
        epoch("000"),
        F.lit("not a date"),
    )
    raw = F.lit(None).cast("string")
    for k, shape in enumerate(shapes):
        raw = F.when(F.col("o_orderkey") % 6 == k, shape).otherwise(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", N.clean_datetime(raw).alias("ts"))


_KIND = """CASE WHEN regexp_matches(regexp_replace(v, '[\\s()-]', '', 'g'), '^(?:\\+92|0092|92|0)?[- ]?(3[0-9]{2})[- ]?([0-9]{7})$') THEN 'phone_pakistan'
 WHEN regexp_matches(regexp_replace(v, '[\\s-]', '', 'g'), '^[0-9]{13}$') THEN 'cnic_pakistan' WHEN regexp_matches(v, '^\\+(?:[0-9] ?){6,14}[0-9]$') THEN 'phone_international'
 WHEN regexp_matches(v, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9.-]+$') THEN 'email'
 WHEN NOT regexp_matches(v, '[-/]') AND regexp_matches(v, '(?i)^[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\\s*[ap]m$') THEN 'duration' WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'datetime'
 WHEN regexp_matches(v, '[$€£¥₹]|PKR|Rs|pkr|rs') AND TRY_CAST(regexp_replace(v, '[^0-9.-]', '', 'g') AS double) IS NOT NULL THEN 'currency_amount' WHEN regexp_matches(v, '^[-+]?[0-9]+(?:\\.[0-9]+)?\\s*%$') THEN 'percentage'
 WHEN regexp_matches(v, '^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$') THEN 'ip_address' WHEN regexp_matches(v, '(?i)^(?:https?://|ftp://|www\\.)[^\\s/$.?#].[^\\s]*$') THEN 'url'
 WHEN lower(v) IN ('true', 'false', 'yes', 'no', 'y', 'n', '1', '0', 't', 'f', 'active', 'inactive', 'pass', 'fail') THEN 'boolean' WHEN lower(v) IN ('male', 'female', 'm', 'other') THEN 'gender'
 WHEN TRY_CAST(v AS double) BETWEEN 0 AND 120 AND TRY_CAST(v AS double) = floor(TRY_CAST(v AS double)) THEN 'age' WHEN length(v) > 10 AND regexp_matches(v, '(?i)\\b(house|road|street)\\b') THEN 'address'
 WHEN regexp_matches(v, '^-?[0-9]+$') THEN 'numeric_integer' WHEN TRY_CAST(v AS double) IS NOT NULL THEN 'numeric_float' ELSE 'other' END"""


@query(f"SELECT event_id, {_KIND} AS kind FROM (SELECT event_id, {MIXED} AS v FROM events)")
def classify_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", P.kind(F.expr(MIXED)).alias("kind"))


@query(f"WITH k AS (SELECT {_KIND} AS kind FROM (SELECT {MIXED} AS v FROM events)) SELECT kind, count(*) AS count, round(count(*) / (SELECT count(*) FROM k), 6) AS ratio FROM k GROUP BY kind")
def kind_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = profile.value_frequencies(table(spark, sf_dir, "events").select(F.expr(MIXED).alias("v")))
    return profile.kinds(freq).select("kind", "count", F.round("ratio", 6).alias("ratio"))


def _union(columns: dict[str, str], source: str, select: str) -> str:
    return " UNION ALL ".join(select.format(name=name, x=x, source=source) for name, x in columns.items())


_ORDER_COLUMNS = {c: c for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")} | {"status": STATUS}


def _order_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.expr(STATUS).alias("status"))


@query(
    _union(
        _ORDER_COLUMNS,
        "orders",
        "SELECT '{name}' AS col_name, count(*) AS total_count, count(*) - count({x}) AS null_count, round((count(*) - count({x})) / count(*), 4) AS null_percentage, count(DISTINCT {x}) AS unique_count FROM {source}",
    )
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.counts_by_column(profile.value_frequencies(_order_columns(spark, sf_dir)))


@query(
    _union(
        {c: x for c, x in _ORDER_COLUMNS.items() if c != "o_orderkey"},
        "orders",
        "SELECT * FROM (SELECT '{name}' AS col_name, CAST({x} AS string) AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, CAST({x} AS string)) AS rank FROM {source} WHERE {x} IS NOT NULL GROUP BY {x}) WHERE rank <= 5",
    )
)
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = profile.value_frequencies(_order_columns(spark, sf_dir).drop("o_orderkey"))
    return profile.top_values(freq).select("col_name", "value", "count", F.col("rank").cast("long").alias("rank"))


_LINE_COLUMNS = {c: c for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS col_name, min({c}) AS min_value, max({c}) AS max_value, round(avg({c}), 2) AS mean_value, round(quantile_cont({c}, 0.5), 2) AS median_value, round(stddev_samp({c}), 2) AS std_dev,
count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)"""
        for c in _LINE_COLUMNS
    )
)
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.numeric_stats(*profile.numeric_values(table(spark, sf_dir, "lineitem").select(*_LINE_COLUMNS)))


@query(
    f"""WITH s AS (SELECT TRY_CAST(regexp_replace(raw, '[$,PKRs\\s]', '', 'g') AS double) AS x FROM (SELECT {MONEY} AS raw FROM orders WHERE o_orderkey % 5 IN (0, 1, 3)) WHERE raw IS NOT NULL),
q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM s)
SELECT 'money' AS col_name, min(x) AS min_value, max(x) AS max_value, round(avg(x), 2) AS mean_value, round(quantile_cont(x, 0.5), 2) AS median_value, round(stddev_samp(x), 2) AS std_dev,
  count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outlier_count FROM s, q"""
)
def profile_text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in a text column, most of whose values hold one."""
    raw = table(spark, sf_dir, "orders").where("o_orderkey % 5 IN (0, 1, 3)").select(F.expr(MONEY).alias("money"))
    return profile.numeric_stats(*profile.numeric_values(raw))


@query(
    f"""SELECT o_orderkey, CASE WHEN regexp_matches(v, '^[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN CAST(v AS double) END AS amount
FROM (SELECT o_orderkey, regexp_replace({MONEY}, '[$,PKRs\\s]', '', 'g') AS v FROM orders)"""
)
def recovered_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", profile.recovered_number(F.expr(MONEY)).alias("amount"))


_DIRTY = {
    "cust_id": "'CUST-' || c_custkey",
    "mob_number": PHONE,
    "nic_number": CNIC,
    "user_email": "'c' || c_custkey || '@mail.example'",
    "patient_age": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(18 + c_custkey % 60 AS string) END",
    "salary_pkr": "'PKR ' || CAST(round(c_acctbal) AS bigint)",
    "segment": "c_mktsegment",
}
_SYNONYMS = ", ".join(f"({i}, '{t.value}', '{w}')" for i, (t, words) in enumerate(ONTOLOGY.items()) for w in words)


def _name_scores(names: str) -> str:
    """SQL: name, type and score of the best type of each of the names (name, c)."""
    return f"""o AS (SELECT * FROM (VALUES {_SYNONYMS}) v(k, t, w)), n AS ({names}),
m AS (SELECT name, k, t, max(CASE WHEN c = w THEN 1.0 WHEN contains(c, w) OR contains(w, c) THEN greatest(0.85, least(length(c), length(w)) / greatest(length(c), length(w)))
  ELSE 1.0 - levenshtein(c, w) / greatest(length(c), length(w)) END) AS score FROM n, o GROUP BY name, k, t),
b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, k) AS i FROM m WHERE score > 0.4),
named AS (SELECT name, t AS type, score::double AS score FROM b WHERE i = 1 UNION ALL SELECT name, 'unknown', 0.0 FROM n WHERE name NOT IN (SELECT name FROM b))"""


#: The counts, the kinds' shares and the rules that fit these columns, in order; all columns are text.
_PROFILED = f"""WITH {_name_scores(" UNION ALL ".join(f"SELECT '{c}' AS name, '{c}' AS c" for c in _DIRTY))},
l AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, {x} AS v FROM customer" for c, x in _DIRTY.items())}),
k AS (SELECT c, {_KIND} AS kind FROM (SELECT c, trim(v) AS v FROM l WHERE trim(v) <> '' AND lower(v) NOT IN ('nan', 'null'))),
r AS (SELECT c, kind, count(*) / (sum(count(*)) OVER (PARTITION BY c)) AS ratio FROM k GROUP BY c, kind),
s AS (SELECT c, count(*) AS total_count, count(*) - count(v) AS null_count, count(DISTINCT v) AS unique_count, min(TRY_CAST(v AS double)) AS low, max(TRY_CAST(v AS double)) AS high FROM l GROUP BY c),
e AS (SELECT s.*, type, score, {", ".join(f"coalesce((SELECT ratio FROM r WHERE r.c = s.c AND kind = '{t}'), 0) AS {a}" for t, a in (("phone_pakistan", "pk"), ("cnic_pakistan", "cn"), ("email", "em"), ("currency_amount", "cu"), ("age", "ag")))}
  FROM s JOIN named ON named.name = s.c),
d AS (SELECT *, CASE WHEN pk > 0.40 OR (pk > 0.20 AND type = 'phone_pakistan') THEN 'phone_pakistan' WHEN cn > 0.50 OR (cn > 0.25 AND type = 'cnic_pakistan') THEN 'cnic_pakistan'
  WHEN em > 0.60 OR (em > 0.30 AND type = 'email') THEN 'email' WHEN type = 'age' AND ((score > 0.70 AND ag > 0.60) OR (low >= 0 AND high <= 115)) THEN 'age'
  WHEN cu > 0.30 OR (type = 'currency_amount' AND score > 0.65) THEN 'currency_amount' WHEN unique_count <= 25 OR (total_count > 50 AND unique_count / total_count < 0.08) THEN 'categorical'
  WHEN score > 0.75 THEN type ELSE 'text_generic' END AS found FROM e),
f AS (SELECT c AS col_name, found AS detected_type, round(CASE found WHEN 'phone_pakistan' THEN least(1, pk * 0.5 + (CASE WHEN type LIKE 'phone%' THEN score ELSE 0.4 END) * 0.5 + 0.2)
  WHEN 'cnic_pakistan' THEN least(1, cn * 0.6 + score * 0.4 + 0.15) WHEN 'email' THEN least(1, em * 0.7 + score * 0.3 + 0.1) WHEN 'age' THEN 0.95
  WHEN 'currency_amount' THEN least(1, cu * 0.5 + score * 0.5 + 0.2) WHEN 'categorical' THEN 0.85 WHEN 'text_generic' THEN 0.6 ELSE score END, 3)::double AS confidence_score, total_count, null_count, unique_count,
  round(CASE found WHEN 'phone_pakistan' THEN pk WHEN 'cnic_pakistan' THEN cn WHEN 'email' THEN em WHEN 'age' THEN ag WHEN 'currency_amount' THEN cu ELSE 0 END, 3)::double AS regex_match_rate,
  round(score, 3) AS col_name_similarity FROM d) """


@query(_PROFILED + "SELECT * FROM f")
def profile_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full profile of a dirty customer table, by fused evidence."""
    return profile.profile(_dirty_customers(spark, sf_dir)).select("col_name", "detected_type", "confidence_score", "total_count", "null_count", "unique_count", "regex_match_rate", "col_name_similarity")


def _dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(*(F.expr(x).alias(c) for c, x in _DIRTY.items()))


@query("SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_returnflag, l_linestatus FROM lineitem)) AS duplicate_rows, 3::bigint AS col_count FROM lineitem")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dataset_summary(table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus")).select(
        F.col("row_count").cast("long").alias("row_count"), F.col("duplicate_rows").cast("long").alias("duplicate_rows"), "col_count"
    )


_SAMPLED = "(SELECT list(v ORDER BY h, v) FROM (SELECT v, md5('0:' || v) AS h FROM (SELECT DISTINCT {c}::string AS v FROM events WHERE {c} IS NOT NULL) ORDER BY h, v LIMIT 10))"


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS col_name, count(*) AS total_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) > 0 AS near, min({c}::string) AS low, max({c}::string) AS high, array_to_string({_SAMPLED.format(c=c)}, ',') AS sample_values FROM events"
        for c in ("event_id", "user_id", "event_type")
    )
)
def merged_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of three batches, kept as tables and merged; ``near`` tells whether the estimate is within 5 % of the truth."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    merged = sketches.merge(*(cut(sketches.sketch(rows.where(F.col("event_id") % 3 == k))) for k in range(3)))
    truth = profile.counts_by_column(profile.value_frequencies(rows)).select("col_name", "unique_count")
    near = F.abs(F.col("unique_estimate") - F.col("unique_count")) <= 0.05 * F.col("unique_count")
    out = sketches.estimates(merged).join(truth, "col_name").withColumn("near", near)
    return out.select("col_name", "total_count", "null_count", "near", "low", "high", F.array_join("sample_values", ",").alias("sample_values"))


_WHEN = "CASE event_id % 4 WHEN 0 THEN (event_id % 17 + 4) || 'th of March 2021' WHEN 1 THEN 'Friday, June ' || (event_id % 28 + 1) || ' 2019, 7 pm' WHEN 2 THEN '2024-03-05' ELSE 'no date ' || event_id END"


@query(
    """WITH n AS (SELECT count(*) AS n, count(CASE WHEN event_id % 4 = 3 THEN 1 END) AS bad FROM events)
SELECT 'kinds' AS what, 'datetime' AS kind, round((n - bad) / n, 6) AS share FROM n UNION ALL SELECT 'kinds', 'other', round(bad / n, 6) FROM n UNION ALL SELECT 'valid', 'datetime', round(round(100 * (n - bad) / n, 2), 6) FROM n"""
)
def any_layout_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in words, told from other texts in kinds and in validation."""
    rows = table(spark, sf_dir, "events").select(F.expr(_WHEN).alias("seen"))
    shares = profile.kinds(profile.value_frequencies(rows), any_layout=True).select(F.lit("kinds").alias("what"), "kind", F.round("ratio", 6).alias("share"))
    report = validate.validate(rows, {"seen": T.DATETIME}, any_layout=True)
    return shares.unionByName(report.select(F.lit("valid").alias("what"), F.lit("datetime").alias("kind"), F.round("compliance_rate", 6).alias("share")))


@query(_PROFILED + "SELECT detected_type, count(*) AS count FROM f GROUP BY detected_type")
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(_dirty_customers(spark, sf_dir)).groupBy("detected_type").count()


@query(
    f"""SELECT 'status' AS col_name, count(*) - count({STATUS}) AS before, 0::bigint AS after FROM orders UNION ALL
SELECT 'o_totalprice', count(*) - count(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END), 0 FROM orders"""
)
def missing_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select(F.expr(STATUS).alias("status"), F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END").alias("o_totalprice"))
    plan = TablePlan({"status": ColumnPlan(T.CATEGORICAL), "o_totalprice": ColumnPlan(T.CURRENCY_AMOUNT)})
    count = lambda df, name: profile.counts_by_column(profile.value_frequencies(df)).select("col_name", F.col("null_count").alias(name))
    return count(raw, "before").join(F.broadcast(count(impute.impute(raw, plan), "after")), "col_name")  # a row a column


def _spiked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(SPIKED).alias("price"))


_IQR = f"""WITH s AS (SELECT o_orderkey, {SPIKED} AS price FROM orders), q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM s),
l AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q) """


@query(_IQR + "SELECT o_orderkey, round(least(greatest(price, lo), hi), 4) AS price FROM s, l")
def outlier_clip_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = outliers.treat_outliers(_spiked(spark, sf_dir), {"price": ColumnPlan(outlier=Outlier.CLIP_IQR)})
    return out.select("o_orderkey", F.round("price", 4).alias("price"))


@query(
    f"""WITH s AS (SELECT o_orderkey, {SPIKED} AS price FROM orders), l AS (SELECT avg(price) - 1.5 * stddev_samp(price) AS lo, avg(price) + 1.5 * stddev_samp(price) AS hi FROM s)
SELECT o_orderkey, round(least(greatest(price, lo), hi), 4) AS price FROM s, l"""
)
def outlier_clip_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = outliers.treat_outliers(_spiked(spark, sf_dir), {"price": ColumnPlan(outlier=Outlier.CLIP_ZSCORE)})
    return out.select("o_orderkey", F.round("price", 4).alias("price"))


@query(_IQR + "SELECT o_orderkey, CASE WHEN price BETWEEN lo AND hi THEN price END AS price FROM s, l")
def outlier_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.treat_outliers(_spiked(spark, sf_dir), {"price": ColumnPlan(outlier=Outlier.SET_NULL)})


@query(_IQR + "SELECT o_orderkey, price FROM s, l WHERE price BETWEEN lo AND hi")
def outlier_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.treat_outliers(_spiked(spark, sf_dir), {"price": ColumnPlan(outlier=Outlier.DROP)})


@query(_IQR + "SELECT 'price' AS col_name, 'clip_iqr' AS strategy, count(*) AS outliers, round(min(lo), 2) AS lower_bound, round(min(hi), 2) AS upper_bound FROM s, l WHERE price < lo OR price > hi")
def outlier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.outlier_report(_spiked(spark, sf_dir).select("price"), {"price": ColumnPlan(outlier=Outlier.CLIP_IQR)})


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(GAPPY).alias("value"))


def _imputed(spark: SparkSession, sf_dir: str, plan: ColumnPlan) -> DataFrame:
    return impute.impute(_gappy(spark, sf_dir), TablePlan({"value": plan, "user_id": ColumnPlan(impute=Impute.NONE)}), "event_id").select("event_id", F.round("value", 4).alias("value"))


_GAPPY = f"WITH s AS (SELECT event_id, user_id, {GAPPY} AS value FROM events) "


@query(_GAPPY + "SELECT event_id, round(coalesce(value, (SELECT round(quantile_cont(value, 0.5), 2) FROM s)), 4) AS value FROM s")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imputed(spark, sf_dir, ColumnPlan(T.NUMERIC_FLOAT))


@query(_GAPPY + "SELECT event_id, round(coalesce(value, (SELECT round(avg(value), 2) FROM s)), 4) AS value FROM s")
def impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imputed(spark, sf_dir, ColumnPlan(T.NUMERIC_FLOAT, Impute.MEAN))


@query(_GAPPY + "SELECT event_id, round(coalesce(value, 7.5), 4) AS value FROM s")
def impute_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imputed(spark, sf_dir, ColumnPlan(T.NUMERIC_FLOAT, Impute.CONSTANT, 7.5))


@query(
    f"""WITH s AS (SELECT o_orderkey, {STATUS} AS status FROM orders), m AS (SELECT status, count(*) AS n FROM s WHERE status IS NOT NULL GROUP BY status ORDER BY n DESC, status LIMIT 1)
SELECT o_orderkey, coalesce(status, (SELECT status FROM m)) AS status FROM s"""
)
def impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(STATUS).alias("status"))
    return impute.impute(raw, TablePlan({"status": ColumnPlan(T.CATEGORICAL), "o_orderkey": ColumnPlan(impute=Impute.NONE)}))


_FILL = "last_value(value IGNORE NULLS) OVER ({p} ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "first_value(value IGNORE NULLS) OVER ({p} ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(_GAPPY + f"SELECT event_id, round(coalesce({_FILL[0].format(p='')}, {_FILL[1].format(p='')}), 4) AS value FROM s")
def impute_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imputed(spark, sf_dir, ColumnPlan(T.NUMERIC_FLOAT, Impute.FORWARD_FILL))


@query(_GAPPY + f"SELECT event_id, round(coalesce({_FILL[1].format(p='')}, {_FILL[0].format(p='')}), 4) AS value FROM s")
def impute_bfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imputed(spark, sf_dir, ColumnPlan(T.NUMERIC_FLOAT, Impute.BACKWARD_FILL))


@query(_GAPPY + f"SELECT event_id, user_id, coalesce({_FILL[0].format(p='PARTITION BY user_id')}, {_FILL[1].format(p='PARTITION BY user_id')}) AS value FROM s")
def impute_ffill_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.fill_along(_gappy(spark, sf_dir), ["value"], "event_id", ["user_id"])


@query(_GAPPY + "SELECT event_id, value FROM s WHERE value IS NOT NULL")
def drop_null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = TablePlan({"value": ColumnPlan(impute=Impute.DROP_ROW)})
    return impute.impute(_gappy(spark, sf_dir).drop("user_id"), plan, "event_id")


_SPARSE = "event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS a, CASE WHEN event_id % 5 < 3 THEN NULL ELSE event_type END AS b, CASE WHEN event_id % 20 > 0 THEN NULL ELSE value END AS c"


@query(f"WITH s AS (SELECT {_SPARSE} FROM events) SELECT * FROM s WHERE ((a IS NULL)::int + (b IS NULL)::int + (c IS NULL)::int) / 4.0 <= 0.6")
def drop_high_null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.drop_null_rows(table(spark, sf_dir, "events").selectExpr(*_split(_SPARSE)))


@query(f"WITH s AS (SELECT {_SPARSE} FROM events) SELECT event_id, a, b FROM s")
def drop_high_null_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.drop_null_columns(table(spark, sf_dir, "events").selectExpr(*_split(_SPARSE)))


def _split(columns: str) -> list[str]:
    return [c if c == "event_id" else f"{c}" for c in columns.split(", ")]


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.drop_exact(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return dedup.drop_exact(rows.unionByName(rows))


_SCORES = """r AS (SELECT p_partkey AS k, trim(lower(p_name)) AS x, length(p_name) AS n, p_brand AS g FROM part),
p AS (SELECT l.k AS a, r.k AS b, l.x, r.x AS y FROM r AS l JOIN r ON l.g = r.g AND l.k < r.k AND least(l.n, r.n) / greatest(l.n, r.n) >= 0.7),
s AS (SELECT a, b, CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN greatest(0.85, least(length(x), length(y)) / greatest(length(x), length(y)))
  ELSE 1.0 - levenshtein(x, y) / greatest(length(x), length(y)) END AS score FROM p)"""


@query(f"WITH {_SCORES} SELECT a, b, round(score::double, 6) AS score FROM s WHERE score >= 0.8")
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar_pairs(table(spark, sf_dir, "part"), ["p_name"], "p_partkey", 0.8, F.col("p_brand")).select("a", "b", F.round("score", 6).alias("score"))


# In rounds: a row stays if all smaller ones that it is similar to are gone, and goes if one of them stays. 50 rounds are more
# than the rows' chains are long.
@query(
    f"""WITH RECURSIVE {_SCORES}, g AS (SELECT b, list(a) AS smaller FROM s WHERE score >= 0.8 GROUP BY b),
o AS (SELECT k, coalesce(smaller, []) AS smaller FROM r LEFT JOIN g ON g.b = r.k),
w AS (SELECT 0 AS i, []::bigint[] AS kept, []::bigint[] AS gone UNION ALL SELECT * FROM (
  SELECT i + 1, coalesce(list(k) FILTER (list_has_all(gone, smaller)), []), coalesce(list(k) FILTER (list_has_any(kept, smaller)), []) FROM w, o GROUP BY i) t(i, kept, gone) WHERE i <= 50)
SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT unnest(kept) FROM w WHERE i = (SELECT max(i) FROM w))"""
)
def fuzzy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.drop_similar(table(spark, sf_dir, "part"), ["p_name"], "p_partkey", 0.8, F.col("p_brand")).select("p_partkey", "p_name")


@query(
    """WITH d AS (SELECT p_name, p_size FROM part), x AS (SELECT DISTINCT * FROM d)
SELECT (SELECT count(*) FROM d) AS initial_rows, (SELECT count(*) FROM d) - (SELECT count(*) FROM x) AS exact_duplicates_removed, 0::bigint AS fuzzy_duplicates_removed, (SELECT count(*) FROM x) AS final_rows"""
)
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_report(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")


@query(
    f"""WITH s AS (SELECT {PHONE} AS phone, {CNIC} AS cnic, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE c_custkey % 90 END AS age FROM customer)
SELECT 'phone' AS col_name, 'phone_pakistan' AS semantic_type, count(*) FILTER (WHERE starts_with(phone, '923') AND length(phone) = 12 OR starts_with(phone, '+923') AND length(phone) = 13 OR starts_with(phone, '03') AND length(phone) = 11) AS valid_count,
  count(phone) AS known, count(*) - count(phone) AS null_count FROM s UNION ALL
SELECT 'cnic', 'cnic_pakistan', count(*) FILTER (WHERE regexp_matches(cnic, '^.{{5}}-.{{7}}-.$')), count(cnic), count(*) - count(cnic) FROM s UNION ALL
SELECT 'c_acctbal', 'currency_amount', count(c_acctbal), count(c_acctbal), 0 FROM s UNION ALL SELECT 'age', 'age', count(*) FILTER (WHERE age BETWEEN 0 AND 120), count(age), 0 FROM s"""
)
def validate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").select(
        F.expr(PHONE).alias("phone"), F.expr(CNIC).alias("cnic"), "c_acctbal", F.expr("CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE c_custkey % 90 END").alias("age")
    )
    report = validate.validate(raw, {"phone": T.PHONE_PAKISTAN, "cnic": T.CNIC_PAKISTAN, "c_acctbal": T.CURRENCY_AMOUNT, "age": T.AGE})
    return report.select("col_name", "semantic_type", "valid_count", (F.col("valid_count") + F.col("invalid_count")).alias("known"), "null_count")


_HITS = "WITH s AS (SELECT *, contains(lower(c_name), '12')::int + contains(c_custkey::string, '12')::int + contains(c_nationkey::string, '12')::int + contains(lower(c_mktsegment), '12')::int AS n FROM (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer)) "


@query(_HITS + "SELECT c_custkey, c_name, c_nationkey, c_mktsegment, n::double AS _score FROM s WHERE n > 0")
def search_multi_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return search.search(rows, {"query": {"multi_match": {"query": "12", "fields": ["*"]}}})


@query(_HITS + "SELECT c_custkey, c_name, n::double AS _score FROM s WHERE n > 0 ORDER BY c_custkey LIMIT 20 OFFSET 10")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return search.page(search.search(rows, {"match": {"c_name": "12"}}), "c_custkey", 20, 10).select("c_custkey", "c_name", "_score")


_BUILD = "CASE WHEN c_custkey % 3 = 0 THEN 'The ' || c_name || ' builds' ELSE c_mktsegment END"


@query(f"SELECT * FROM (SELECT c_custkey, {_BUILD} AS what, c_mktsegment, (contains(lower({_BUILD}), 'build')::int + contains(lower(c_mktsegment), 'build')::int)::double AS _score FROM customer) WHERE _score > 0")
def search_gram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that reads the lists of its trigrams, and of the rows those that are in all of them."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_BUILD).alias("what"), "c_mktsegment")
    return GramIndex(spark, shared_path(spark, "grams"), 8).build(rows).search({"multi_match": {"query": "Build"}})


@query(
    """WITH t AS (SELECT p_partkey AS k, p_partkey // 3 AS g, p_partkey % 3 AS v, 18 + length(p_name) AS n FROM (SELECT p_partkey, (SELECT any_value(o.p_name) FROM part o WHERE o.p_partkey = p.p_partkey // 3 * 3) AS p_name FROM part p) WHERE p_name IS NOT NULL)
SELECT x.k AS a, y.k AS b, round(CASE WHEN x.v = 0 AND y.v = 1 THEN 1.0 WHEN x.v = 0 THEN greatest(0.85, x.n / (x.n + 1)) ELSE 2 * x.n / (2 * x.n + 1) END, 9) AS score FROM t x JOIN t y ON x.g = y.g AND x.k < y.k"""
)
def fuzzy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of three parts each: two codes and a name, the same words turned round, and with a letter more."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    named = parts.where("p_partkey % 3 = 0").select(F.expr("p_partkey div 3").alias("g"), F.col("p_name").alias("name"))
    code = F.md5(F.col("g").cast("string").cast("binary"))
    words = F.array(F.substring(code, 1, 8), F.substring(code, 9, 8), "name")
    turned = F.array_join(F.reverse(F.split(F.array_join(words, " "), " ")), " ")
    text = F.when(F.col("p_partkey") % 3 == 1, turned).when(F.col("p_partkey") % 3 == 2, F.concat(F.array_join(words, " "), F.lit("x"))).otherwise(F.array_join(words, " "))
    rows = parts.withColumn("g", F.expr("p_partkey div 3")).join(named, "g").select("p_partkey", text.alias("text"))
    return dedup.similar_pairs(rows, ["text"], "p_partkey", 0.85, mode="tokens").select("a", "b", F.round("score", 9).alias("score"))


@query("SELECT r_regionkey, r_name, 1.0::double AS _score FROM region")
def search_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), {"query": {"match_all": {}}})


@query(_HITS + "SELECT count(*) AS total FROM s WHERE n > 0")
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return search.search(rows, {"query_string": {"query": "12"}}).agg(F.count(F.lit(1)).alias("total"))


@query(
    """SELECT 'nation' AS _index, n_name AS name FROM nation WHERE contains(lower(n_name), '1') OR contains(n_nationkey::string, '1') UNION ALL
SELECT 'region', r_name FROM region WHERE contains(lower(r_name), '1') OR contains(r_regionkey::string, '1')"""
)
def search_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"nation": table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_nationkey"), "region": table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), "r_regionkey")}
    return search.search_many(tables, {"match": {"name": "1"}}).select("_index", F.get_json_object("_source", "$.name").alias("name"))


_NAMES = ("mob_number", "cust_id", "patient age", "d_o_b", "shipping_address", "humidity_pct", "zzz", "duration", "o_orderdate", "l_tax")


_NAMED = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' || event_type ELSE '-' || upper(event_type) END"
_CLEAN = "regexp_replace(replace(replace(lower(name), ' ', '_'), '-', '_'), '[^a-z0-9_]', '', 'g')"


def _best_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(n, *match_name(n)[0]) for n in batch.column("name").to_pylist()]
        rows = [(n, t.value, round(float(s), 6)) for n, t, s in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.float64()))], names=["name", "type", "score"])


@query("WITH " + _name_scores(f"SELECT name, {_CLEAN} AS c FROM (SELECT DISTINCT {_NAMED} AS name FROM events)") + " SELECT name, type, round(score, 6) AS score FROM named")
def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different name once, wherever it stands."""
    names = table(spark, sf_dir, "events").select(F.expr(_NAMED).alias("name")).distinct()
    return map_arrow(names, _best_types, "name string, type string, score double")


@query(
    """WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events), n AS (SELECT *, sum(CASE WHEN event_id % 11 = 1 THEN 1 ELSE 2 END) OVER (ORDER BY event_id) - CASE WHEN event_id % 11 = 1 THEN 1 ELSE 2 END AS line FROM e)
SELECT CASE event_id % 11 WHEN 2 THEN 'generic_dataset' ELSE 'ev' END AS _index, CASE event_id % 11 WHEN 3 THEN (line // 2 + 1)::bigint::string ELSE event_id::string END AS _id,
  CASE event_id % 11 WHEN 4 THEN 'nested' ELSE json_extract_string(props, '$.k') END AS k FROM n WHERE event_id % 11 NOT IN (0, 1)"""
)
def bulk_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with blanks between them, junk, actions without source, without index or id, and sources that look like actions."""
    events = table(spark, sf_dir, "events").select("event_id", "props")
    shape, quoted = F.col("event_id") % 11, F.concat(F.lit('"'), "event_id", F.lit('"'))
    action = (
        F.when(shape == 0, "not an action")
        .when(shape == 1, "")
        .when(shape == 2, F.concat(F.lit('{"create": {"_id": '), quoted, F.lit("}}")))
        .when(shape == 3, F.lit('{"index": {"_index": "EV"}}'))
        .otherwise(F.concat(F.lit('{"index": {"_index": "Ev", "_id": '), quoted, F.lit("}}")))
    )
    source = F.when(shape == 4, F.lit('{"index": {"k": "nested"}, "k": "nested"}')).when(shape == 1, "no object").otherwise(F.col("props"))
    at = lambda i: 4 * F.col("event_id") + i
    lines = F.array(*(F.struct(at(i).alias("line_no"), x.alias("line")) for i, x in enumerate((action, F.lit("   "), source, F.lit("")))))
    return sinks.parse_bulk(events.select(F.explode(lines).alias("x")).select("x.*")).select("_index", "_id", F.get_json_object("_source", "$.k").alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k')::bigint AS \"p.k\", json_extract_string(props, '$.k')::bigint + 1 AS \"p.deep.n\" FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k bigint")
    nested = F.struct(parsed["k"].alias("k"), F.struct((parsed["k"] + 1).alias("n")).alias("deep"))
    return readers.flatten(table(spark, sf_dir, "events").select("event_id", nested.alias("p")))


@query("SELECT (row_number() OVER (ORDER BY r_regionkey))::string AS _id, r_name AS name FROM region")
def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("_row_id"), F.col("r_name").alias("name"))
    return sinks.documents(rows, "regions", "_row_id").select("_id", F.get_json_object("_source", "$.name").alias("name"))


@query("SELECT r_regionkey::string AS _id, CASE WHEN r_regionkey < 2 THEN upper(r_name) || '!' ELSE r_name END AS _source FROM region")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("_id"), F.col("r_name").alias("_source"))
    new = old.where("_id < '2'").withColumn("_source", F.concat(F.upper("_source"), F.lit("!")))
    return sinks.upsert(old, new)


@query(
    _PROFILED
    + """SELECT col_name AS field, CASE detected_type WHEN 'age' THEN 'long' WHEN 'identifier_id' THEN 'long' WHEN 'currency_amount' THEN 'double' WHEN 'categorical' THEN 'keyword' ELSE 'text' END AS type FROM f"""
)
def mapping_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index fields of the columns whose types the profile found."""
    fields = index_mapping(profile.detected_types(profile.profile(_dirty_customers(spark, sf_dir))))["mappings"]["properties"]
    return spark.createDataFrame([(c, f["type"]) for c, f in fields.items()], "field string, type string")


@query(
    f"""WITH s AS (SELECT c_custkey, {PHONE} AS raw FROM customer), d AS (SELECT *, ltrim(regexp_replace({_KNOWN.format("raw")}, '[^0-9]', '', 'g'), '0') AS bare FROM s)
SELECT c_custkey::string AS id, CASE WHEN bare <> '' THEN '92' || CASE WHEN length(bare) = 12 AND starts_with(bare, '923') THEN substr(bare, 3)
  WHEN length(bare) >= 10 AND strpos(bare, '3') BETWEEN 1 AND 3 AND length(bare) - strpos(bare, '3') + 1 = 10 THEN substr(bare, strpos(bare, '3')) ELSE bare END END AS phone FROM d"""
)
def normalize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.expr(PHONE).alias("phone"))
    return normalize_table(raw, TablePlan({"id": ColumnPlan(T.IDENTIFIER_ID), "phone": ColumnPlan(T.PHONE_PAKISTAN)}))


# Queries that run whole parts of the library.
_VISITS = "SELECT c_custkey, {PHONE} AS phone, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 41 = 0 THEN 900 ELSE 20 + c_custkey % 37 END AS age, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS city FROM customer".replace("{PHONE}", PHONE)
_VISIT_TYPES = {"phone": T.PHONE_PAKISTAN, "age": T.AGE, "city": T.CITY}


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"phone": PHONE, "age": "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 41 = 0 THEN 900 ELSE 20 + c_custkey % 37 END", "city": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END"}
    return table(spark, sf_dir, "customer").select("c_custkey", *(F.expr(x).alias(c) for c, x in columns.items()))


_PHONE_SQL = f"""CASE WHEN bare <> '' THEN '92' || CASE WHEN length(bare) = 12 AND starts_with(bare, '923') THEN substr(bare, 3)
  WHEN length(bare) >= 10 AND strpos(bare, '3') BETWEEN 1 AND 3 AND length(bare) - strpos(bare, '3') + 1 = 10 THEN substr(bare, strpos(bare, '3')) ELSE bare END END"""
_CLEANED = f"""WITH v AS ({_VISITS}), p AS (SELECT *, ltrim(regexp_replace({_KNOWN.format("phone")}, '[^0-9]', '', 'g'), '0') AS bare FROM v),
q AS (SELECT quantile_cont(age, 0.25) AS a, quantile_cont(age, 0.75) AS b FROM v),
c AS (SELECT c_custkey, coalesce({_PHONE_SQL}, 'Unknown') AS phone, CASE WHEN age IS NOT NULL THEN least(greatest(age, a - 1.5 * (b - a)), b + 1.5 * (b - a)) END AS age, city FROM p, q),
m AS (SELECT round_even(quantile_cont(age, 0.5), 0) AS age, (SELECT city FROM c WHERE city IS NOT NULL GROUP BY city ORDER BY count(*) DESC, city LIMIT 1) AS city FROM c),
f AS (SELECT c_custkey, phone, CAST(trunc(coalesce(c.age, m.age)) AS bigint) AS age, coalesce(c.age, m.age) AS exact_age, coalesce(c.city, m.city) AS city FROM c, m) """


@query(_CLEANED + "SELECT min(c_custkey) AS c_custkey, phone, age, city FROM f GROUP BY phone, exact_age, age, city")
def clean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default plan of given types, run whole: normalized, clipped, filled, without repeated rows, in final types."""
    return clean(_visits(spark, sf_dir), default_plan(_VISIT_TYPES), "c_custkey")


@query(
    f"""WITH v AS ({_VISITS}), n AS (SELECT count(*) - count(phone) AS phone, count(*) - count(age) AS age, count(*) - count(city) AS city FROM v)
SELECT 'phone' AS col_name, 'constant' AS strategy, phone AS nulls_before, phone AS nulls_handled, 'Unknown' AS imputed_value FROM n UNION ALL
SELECT 'age', 'median', age, age, (SELECT round_even(quantile_cont(age, 0.5), 0)::bigint::string FROM v) FROM n UNION ALL
SELECT 'city', 'mode', city, city, (SELECT city FROM v WHERE city IS NOT NULL GROUP BY city ORDER BY count(*) DESC, city LIMIT 1) FROM n"""
)
def impute_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.impute_report(_visits(spark, sf_dir), default_plan(_VISIT_TYPES), "c_custkey")


@query(f"SELECT o_orderkey, {SPIKED} AS price FROM orders")
def outlier_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.treat_outliers(_spiked(spark, sf_dir), {"price": ColumnPlan(outlier=Outlier.NONE)})


@query("SELECT count(*) AS n, 0::bigint AS first, count(*) - 1 AS last, count(*) AS different FROM events WHERE event_id % 3 > 0")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers over several partitions have no gaps."""
    rows = readers.with_row_id(table(spark, sf_dir, "events").repartition(7, "user_id").where("event_id % 3 > 0"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("_row_id").alias("first"), F.max("_row_id").alias("last"), F.count_distinct("_row_id").alias("different"))


_MAIL = "CASE c_custkey % 3 WHEN 0 THEN 'a' || c_custkey || '@mail.example' WHEN 1 THEN 'no address' ELSE NULL END"
_DAY = "CASE c_custkey % 4 WHEN 0 THEN '2024-01-15 10:00:00' WHEN 1 THEN '15 Jan 2024' WHEN 2 THEN 'sometime' ELSE NULL END"
_SPELL = "CASE c_custkey % 3 WHEN 0 THEN '1:05:09' WHEN 1 THEN '12:30' ELSE 'an hour' END"
_WEIGHT = "CASE c_custkey % 4 WHEN 0 THEN '1.5' WHEN 1 THEN '-2e3' WHEN 2 THEN 'heavy' ELSE NULL END"
_FORMATS = {"mail": (_MAIL, T.EMAIL, "@"), "day": (_DAY, T.DATE, "[0-9]"), "spell": (_SPELL, T.DURATION, ":"), "weight": (_WEIGHT, T.NUMERIC_FLOAT, "[0-9]"), "note": ("c_name", T.TEXT_GENERIC, ".")}


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").select(*(F.expr(x).alias(c) for c, (x, _, _) in _FORMATS.items()))
    return validate.validate(raw, {c: t for c, (_, t, _) in _FORMATS.items()})


_FORMATS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, '{t.value}' AS semantic_type, count(*) FILTER (WHERE regexp_matches(x, '{ok}')) AS valid_count, count(*) FILTER (WHERE NOT regexp_matches(x, '{ok}')) AS invalid_count, count(*) - count(x) AS null_count FROM (SELECT {x} AS x FROM customer)"
    for c, (x, t, ok) in _FORMATS.items()
)


@query(_FORMATS_SQL)
def validate_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formats(spark, sf_dir).select("col_name", "semantic_type", "valid_count", "invalid_count", "null_count")


@query(f"WITH f AS ({_FORMATS_SQL}) SELECT sum(valid_count) / sum(valid_count + invalid_count) >= 0.8 AS passed, count(*) FILTER (WHERE invalid_count > 0) AS anomalies FROM f")
def validate_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _formats(spark, sf_dir)
    return spark.createDataFrame([(validate.passed(report), validate.anomalies(report).count())], "passed boolean, anomalies long")


_MORE = """CASE event_id % 16 WHEN 0 THEN '13:45' WHEN 1 THEN '2:30:15' WHEN 2 THEN '5 hours' WHEN 3 THEN 'fe80:0:0:0:0:0:0:' || CAST(event_id % 9 AS string) WHEN 4 THEN 'www.x.example/' || CAST(event_id AS string)
 WHEN 5 THEN 'ftp://x.example/f' WHEN 6 THEN '12/25/2023' WHEN 7 THEN 'Jan 5, 2024' WHEN 8 THEN '1700000000' WHEN 9 THEN '0.5' WHEN 10 THEN '-3.25' WHEN 11 THEN '-' || CAST(event_id AS string) WHEN 12 THEN '+92 300 1234567'
 WHEN 13 THEN '12.5 %' WHEN 14 THEN 'Plot 12, Sector ' || CAST(event_id AS string) ELSE '€ ' || CAST(event_id AS string) || '.75' END"""
_MORE_KIND = """CASE WHEN regexp_matches(replace(v, ' ', ''), '^\\+923[0-9]{9}$') THEN 'phone_pakistan' WHEN regexp_matches(v, '^[0-9]{1,3}:[0-9]{2}(:[0-9]{2})?$') OR regexp_matches(v, '^[0-9]+ hours$') THEN 'duration'
 WHEN regexp_matches(v, '^([0-9]{10}|[0-9]+/[0-9]+/[0-9]{4}|[A-Z][a-z]{2} [0-9]+, [0-9]{4})$') THEN 'datetime' WHEN regexp_matches(v, '€') THEN 'currency_amount' WHEN regexp_matches(v, '%$') THEN 'percentage'
 WHEN regexp_matches(v, '^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$') THEN 'ip_address' WHEN regexp_matches(v, '^(www\\.|ftp://)') THEN 'url' WHEN regexp_matches(v, '(?i)\\bsector\\b') THEN 'address'
 WHEN regexp_matches(v, '^-[0-9]+$') THEN 'numeric_integer' ELSE 'numeric_float' END"""


@query(f"SELECT event_id, CASE WHEN v = '-0' THEN 'age' ELSE {_MORE_KIND} END AS kind FROM (SELECT event_id, {_MORE} AS v FROM events)")
def classify_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", P.kind(F.expr(_MORE)).alias("kind"))


@query(
    """WITH s AS (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 5 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 3 AND day(d) <= 12 THEN strftime(make_date(year(d), day(d), month(d)), '%Y-%m-%d') ELSE strftime(d, '%Y-%m-%d') END || CASE WHEN k = 4 THEN ' 07:05:00' ELSE ' 00:00:00' END AS ts FROM s"""
)
def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of months, and days before months, which are read so only if they can't be months."""
    raw = F.lit(None).cast("string")
    for k, layout in enumerate(("d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d-M-yyyy", "yyyy-M-d '7:05'")):
        raw = F.when(F.col("o_orderkey") % 5 == k, F.date_format("o_orderdate", layout)).otherwise(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", N.clean_datetime(raw).alias("ts"))


@query("SELECT c_custkey::string AS c_custkey, c_name, c_mktsegment || '; \"x\"' AS c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat("c_mktsegment", F.lit('; "x"')).alias("c_mktsegment")), path)
    return readers.extract(spark, path, "csv")


@query("SELECT event_id, user_id AS \"who.user\", event_type AS \"who.kind.name\" FROM events")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "json")
    who = F.struct(F.col("user_id").alias("user"), F.struct(F.col("event_type").alias("name")).alias("kind"))
    sinks.write_json(table(spark, sf_dir, "events").select("event_id", who.alias("who")), path)
    return readers.extract(spark, path, "json")


@query("SELECT 'csv' AS format, ';' AS delimiter, 'ISO-8859-1' AS encoding, count(*) AS row_count, 3::bigint AS col_count FROM customer")
def source_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of a source that another program wrote, from all of its rows."""
    path = shared_path(spark, "csv")
    rows = table(spark, sf_dir, "customer").select("c_name", F.concat(F.lit("größe "), "c_custkey").alias("größe"), "c_mktsegment")
    rows.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    _, meta = readers.extract_with_meta(spark, path, "csv")
    return spark.createDataFrame([tuple(meta[k] for k in ("format", "delimiter", "encoding", "row_count", "col_count"))], "format string, delimiter string, encoding string, row_count long, col_count long")


def _written(spark: SparkSession, out: DataFrame, path: str | None = None) -> DataFrame:
    """The rows that a stream gives, written to the shared folder until its source is read; at a path once more, all of both runs."""
    path = path or shared_path(spark, "stream")
    started = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def _streamed(spark: SparkSession, sf_dir: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that a stream over the events gives."""
    schema = table(spark, sf_dir, "events").schema
    return _written(spark, transform(spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")))


@query("SELECT event_id, upper(event_type) AS event_type, least(greatest(value, 2.0), 40.0) AS value FROM events")
def stream_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = TablePlan({"event_type": ColumnPlan(T.CATEGORICAL, casing="upper"), "value": ColumnPlan(T.NUMERIC_FLOAT, outlier=Outlier.CLIP_IQR)})
    return _streamed(spark, sf_dir, lambda rows: clean_stream(rows.select("event_id", "event_type", "value"), plan, {"value": (2.0, 40.0)}))


@query(_GAPPY + f"SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM s")
def stream_fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of four batches, each of later events in any number of files; a user's last value is kept between them.

    It stops after each batch and goes on from its state when the files of the next one are all there.
    """
    rows, path = _gappy(spark, sf_dir), shared_path(spark, "stream")
    last = rows.agg(F.max("event_id")).first()[0] or 0
    for k in range(4):
        rows.where(F.floor(F.col("event_id") * 4 / (last + 1)) == k).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        out = _written(spark, fill_forward(stream, ["value"], ["user_id"], "event_id"), path)
    return out


@query("SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END, 'none') AS event_type, value FROM (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events) WHERE value IS NOT NULL")
def stream_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls of a stream that get a value fitted on a table at rest, and rows that are left out for a null."""
    plan = TablePlan({"event_type": ColumnPlan(T.CATEGORICAL, impute=Impute.CONSTANT, constant="none"), "value": ColumnPlan(T.NUMERIC_FLOAT, impute=Impute.DROP_ROW)})
    shape = "event_id", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS event_type", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value"
    fills = fitted_fills(table(spark, sf_dir, "events").selectExpr(*shape), plan)
    return _streamed(spark, sf_dir, lambda rows: fill_stream(rows.selectExpr(*shape), plan, fills))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda rows: drop_repeats(rows.select("ts", "user_id", "event_type"), ["user_id", "event_type"], "ts", "400 days").select("user_id", "event_type"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'new ' WHEN c_custkey % 5 = 1 THEN 'newer ' ELSE '' END || c_name AS c_name FROM customer")
def index_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that is loaded, then loaded with new documents of some ids and again of others."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("_row_id"), "c_custkey", "c_name")
    index = sinks.Index(spark, f"Customers {shared_path(spark, 'index')[-32:]}")
    index.load(rows, {"c_name": T.CATEGORICAL}, "_row_id")
    for word, some in (("new ", "c_custkey % 5 IN (0, 1)"), ("newer ", "c_custkey % 5 = 1")):
        index.load(rows.where(some).withColumn("c_name", F.concat(F.lit(word), "c_name")), {"c_name": T.CATEGORICAL}, "_row_id", overwrite=False)
    source = F.from_json("_source", "c_custkey bigint, c_name string").alias("s")
    found = cut(spark.table(index.name).select(source).select("s.*"))
    index.delete()
    return found


def _framed(head: str | None, tail: str | None, between: str):
    """The lines of each file with a line before and one after them, and a mark before each but the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = ""
        if head is not None:
            yield pa.RecordBatch.from_pydict({"value": [head]})
        for batch in batches:
            values = batch.column("value").to_pylist()
            if values:
                marks = [mark, *[between] * (len(values) - 1)]
                yield pa.RecordBatch.from_pydict({"value": [m + v for m, v in zip(marks, values)]})
                mark = between
        if tail is not None:
            yield pa.RecordBatch.from_pydict({"value": [tail]})

    return run


def _files(spark: SparkSession, lines: DataFrame, kind: str, head: str | None = None, tail: str | None = None, between: str = "", sep: str = "\n") -> str:
    """The path of text files of the lines (a column ``value``), three or more, framed each by itself."""
    path = shared_path(spark, kind)
    map_arrow(lines.select("value").repartition(3), _framed(head, tail, between), "value string").write.option("lineSep", sep).text(path)
    return path


_GAPS = "CASE c_custkey % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN '' WHEN 2 THEN 'null' WHEN 3 THEN c_name ELSE 'none of these' END"


@query(f"SELECT c_custkey::string AS key, CASE WHEN c_custkey % 5 < 3 THEN NULL ELSE {_GAPS} END AS name FROM customer")
def csv_missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand for a missing value are null, others stay; the delimiter is found."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("|"), F.expr(_GAPS)).alias("value"))
    return readers.extract(spark, _files(spark, rows, "csv", "key|name"), "csv")


@query("SELECT c_custkey::string AS key, c_name AS name, CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE c_nationkey::string END AS nation FROM customer WHERE c_custkey % 3 < 2")
def csv_uneven_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short rows end with nulls, rows with more values than names are left out."""
    shape = "CASE c_custkey % 3 WHEN 0 THEN ';' || c_nationkey WHEN 1 THEN '' ELSE ';' || c_nationkey || ';more;fields' END"
    rows = table(spark, sf_dir, "customer").select(F.expr(f"c_custkey || ';' || c_name || {shape}").alias("value"))
    return readers.extract(spark, _files(spark, rows, "csv", "key;name;nation"), "csv")


@query(
    """SELECT o_orderkey::string AS key, CASE o_orderkey % 4 WHEN 0 THEN 'two' || chr(10) || 'lines, ' || o_orderkey WHEN 1 THEN 'a "' || o_orderpriority || '"' || chr(10) || chr(10) || 'end' WHEN 2 THEN '5" pipe' ELSE o_orderpriority END AS note,
  CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 5 <> 2"""
)
def csv_quoted_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line breaks, delimiters and doubled quotes within quotes, quotes within plain values, short and overlong rows."""
    note = """CASE o_orderkey % 4 WHEN 0 THEN '"two\\nlines, ' || o_orderkey || '"' WHEN 1 THEN '"a ""' || o_orderpriority || '""\\n\\nend"' WHEN 2 THEN '5" pipe' ELSE o_orderpriority END"""
    rest = "CASE o_orderkey % 5 WHEN 1 THEN '' WHEN 2 THEN ',' || o_orderstatus || ',more' ELSE ',' || o_orderstatus END"
    rows = table(spark, sf_dir, "orders").select(F.expr(f"o_orderkey || ',' || {note} || {rest}").alias("value"))
    return readers.extract(spark, _files(spark, rows, "csv", "key,note,status"), "csv")


_RECORD = "'{\"key\": ' || c_custkey || ', \"of\": {\"name\": \"' || c_name || ' }]\"}}'"


@query("SELECT c_custkey::bigint AS key, c_name || ' }]' AS \"of.name\" FROM customer WHERE c_custkey % 4 > 0")
def json_lines_with_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no object of their own are left out."""
    rows = table(spark, sf_dir, "customer").select(F.expr(f"CASE WHEN c_custkey % 4 = 0 THEN '{{broken' ELSE {_RECORD} END").alias("value"))
    return readers.extract(spark, _files(spark, rows, "json"), "json")


@query("SELECT c_custkey::bigint AS key, c_name || ' }]' AS \"of.name\" FROM customer")
def json_wrapped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that hold their records in an array, beside another one, over several lines; each file has its own."""
    rows = table(spark, sf_dir, "customer").select(F.expr(_RECORD).alias("value"))
    return readers.extract(spark, _files(spark, rows, "json", '{"total": {"of": [1]}, "other": [{"key": -1}], "records": [', "]}", ", "), "json")


@query("SELECT c_custkey::bigint AS key, c_name || ' }]' AS \"of.name\" FROM customer")
def json_one_line_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays without a line break in them."""
    rows = table(spark, sf_dir, "customer").select(F.expr(_RECORD).alias("value"))
    return readers.extract(spark, _files(spark, rows, "json", "[", "]", ", ", " "), "json")


@query("SELECT r_regionkey::bigint AS key, r_name AS name FROM region")
def json_array_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part files of the array sink, one after another, are one array."""
    path = shared_path(spark, "json")
    sinks.write_json(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), path, array=True)
    lines = spark.read.text(path).select(F.rtrim(F.regexp_replace("value", r"^\[|[,\]]$", "")).alias("value")).where("value <> ''")
    return lines.select(F.from_json("value", "key bigint, name string").alias("s")).select("s.*")


def _told_formats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, readers.detect_format(n, h.encode()), readers.sniff_delimiter(t)) for k, n, h, t in zip(*(batch.column(c).to_pylist() for c in ("c_custkey", "name", "head", "text")))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["c_custkey", "format", "delimiter"])


@query(
    """SELECT c_custkey::bigint AS c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'parquet' WHEN 3 THEN 'excel' WHEN 4 THEN 'csv' ELSE 'json' END AS format,
  CASE c_custkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END AS delimiter FROM customer"""
)
def detected_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by extensions and first bytes, delimiters by a head, of sources named after the customers."""
    name = "c_name || element_at(array('', '.jsonl', '.pq', '.XLSX', '.tsv', ''), cast(c_custkey % 6 AS int) + 1)"
    mark = "element_at(array(',', ';', '\\t', '|'), cast(c_custkey % 4 AS int) + 1)"
    text = f"concat('a', {mark}, 'b', {mark}, 'c\\n1', {mark}, '2', {mark}, c_mktsegment, '\\n')"
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.expr(name).alias("name"), F.expr(text).alias("text"))
    rows = rows.withColumn("head", F.expr("IF(c_custkey % 6 = 5, ' [{\"a\": 1}]', text)"))
    return map_arrow(rows, _told_formats, "c_custkey long, format string, delimiter string")


@query("SELECT r_regionkey, r_name, 1.0::double AS _score FROM region")
def search_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clause without support matches everything."""
    return search.search(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), {"query": {"range": {"r_regionkey": {"gte": 3}}}})


@query("SELECT 'docs' AS name, count(*)::string AS value FROM customer UNION ALL SELECT 'c_custkey', 'long' UNION ALL SELECT 'c_mktsegment', 'keyword' UNION ALL SELECT 'deleted', (count(*) > 0)::string FROM customer")
def index_admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of indexes with their documents, the mapping of one, and its end."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("_row_id"), "c_custkey", "c_mktsegment")
    index = sinks.Index(spark, f"Admin {shared_path(spark, 'index')[-32:]}")
    index.load(rows, {"c_custkey": T.NUMERIC_INTEGER, "c_mktsegment": T.CATEGORICAL}, "_row_id")
    docs = sinks.indices(spark).where(F.col("index") == index.name).first()["docs"]
    fields = [(c, f["type"]) for c, f in index.mapping()["mappings"]["properties"].items()]
    index.delete()
    return spark.createDataFrame([("docs", str(docs)), *fields, ("deleted", str(not index.exists()).lower())], "name string, value string")


@query(
    """WITH s AS (SELECT event_id, CASE WHEN event_id = 5 THEN NULL ELSE event_id END AS pos, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value FROM events)
SELECT event_id, coalesce(last_value(value IGNORE NULLS) OVER (ORDER BY pos NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(value IGNORE NULLS) OVER (ORDER BY pos NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM s"""
)
def fill_null_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without order comes first and stays."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "IF(event_id = 5, NULL, event_id) AS pos", f"{GAPPY} AS value")
    return impute.fill_along(rows, ["value"], "pos").select("event_id", "value")


@query("SELECT 'nothing' AS col_name, 'all_null' AS validation_type, 0.0::double AS compliance_rate, count(CASE WHEN c_custkey < 0 THEN c_name END) AS valid_count, count(*) AS invalid_count, count(*) AS null_count FROM customer")
def validate_all_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.expr("CASE WHEN c_custkey < 0 THEN c_name END").alias("nothing"))
    return validate.validate(rows, {"nothing": T.EMAIL}).drop("semantic_type")


@query(f"SELECT c_custkey, {_MAIL} AS mail, c_mktsegment, 1.0::double AS _score FROM customer WHERE c_custkey % 3 = 0")
def search_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field's match clause with options searches all fields for its text, whatever the case; blanks don't match."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_MAIL).alias("mail"), "c_mktsegment")
    return search.search(rows, {"match": {"mail": {"query": "@MAIL.example", "operator": "and"}}})
