"""Operators and functions on values."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import dialect as D
from lodestar.queries import frame, sql
from lodestar.session import table

sql("between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
sql("not_between", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 20")
sql("in_list", "SELECT event_id FROM events WHERE event_type IN ('click', 'error')")
sql("not_in_list", "SELECT event_id FROM events WHERE event_type NOT IN ('click', 'error')")
sql("like", "SELECT p_partkey FROM part WHERE p_name LIKE '%a_e%'")
sql("not_like", "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%a_e%'")
sql("ilike", "SELECT p_partkey FROM part WHERE p_type ILIKE '%BraSS%'")
sql("like_escape", "SELECT s, s LIKE '10\\\\%' AS exact FROM (VALUES ('10%'), ('100')) AS t(s)", "SELECT s, s LIKE '10\\%' ESCAPE '\\' AS exact FROM (VALUES ('10%'), ('100')) AS t(s)")
sql("like_any", "SELECT p_partkey FROM part WHERE p_name LIKE ANY ('a%', '%z%')", "SELECT p_partkey FROM part WHERE p_name LIKE 'a%' OR p_name LIKE '%z%'")
sql("like_all", "SELECT p_partkey FROM part WHERE p_name LIKE ALL ('%a%', '%e%')", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_name LIKE '%e%'")
sql("regexp", "SELECT p_partkey FROM part WHERE p_brand RLIKE '#[12][1-3]$'", "SELECT p_partkey FROM part WHERE REGEXP_MATCHES(p_brand, '#[12][1-3]$')")
sql("not_regexp", "SELECT p_partkey FROM part WHERE p_brand NOT RLIKE '#[12]'", "SELECT p_partkey FROM part WHERE NOT REGEXP_MATCHES(p_brand, '#[12]')")
sql("regexp_ci", "SELECT p_partkey FROM part WHERE p_type RLIKE '(?i)^s.*l$'", "SELECT p_partkey FROM part WHERE REGEXP_MATCHES(p_type, '^s.*l$', 'i')")
sql("arith_add_sub_mul", "SELECT l_orderkey, l_linenumber, l_orderkey + l_partkey AS a, l_partkey - l_suppkey AS b, l_linenumber * 3 AS c FROM lineitem")
sql("arith_int_div", "SELECT l_orderkey, l_linenumber, l_orderkey DIV 7 AS q, -l_orderkey DIV 7 AS nq FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(TRUNC(l_orderkey / 7) AS BIGINT) AS q, CAST(TRUNC(-l_orderkey / 7) AS BIGINT) AS nq FROM lineitem")
sql("arith_float_div", "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit FROM lineitem")
sql("arith_mod", "SELECT l_orderkey, l_linenumber, l_orderkey % 7 AS r, -l_orderkey % 7 AS nr FROM lineitem")
sql("unary_minus", "SELECT c_custkey, -c_acctbal AS owed FROM customer")
sql("bit_and_or_xor", "SELECT l_orderkey, l_linenumber, l_orderkey & 12 AS a, l_orderkey | 3 AS o, l_orderkey ^ 5 AS x FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey & 12 AS a, l_orderkey | 3 AS o, XOR(l_orderkey, 5) AS x FROM lineitem")
sql("bit_shift", "SELECT p_partkey, p_partkey << 2 AS l, p_partkey >> 1 AS r FROM part")
sql("bit_not", "SELECT p_partkey, ~p_partkey AS inv FROM part")
sql("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' END AS band FROM orders")
sql("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s FROM orders")
sql("coalesce", "SELECT c_custkey, COALESCE(NULLIF(c_nationkey, 7), -1) AS k FROM customer")
sql("cast_matrix", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS BIGINT) AS i, CAST(l_linenumber AS DOUBLE) AS d, CAST(l_orderkey AS STRING) AS s, CAST('12' AS INT) AS n FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(TRUNC(l_extendedprice) AS BIGINT) AS i, CAST(l_linenumber AS DOUBLE) AS d, CAST(l_orderkey AS VARCHAR) AS s, CAST('12' AS INT) AS n FROM lineitem")
sql("try_cast_extra", "SELECT TRY_CAST(x AS INT) AS n FROM (VALUES ('1'), ('a')) AS t(x)")
sql("str_lower_upper", "SELECT p_partkey, LOWER(p_type) AS l, UPPER(p_name) AS u FROM part")
sql("str_length_bytes", "SELECT doc_id, OCTET_LENGTH(text) AS b FROM documents", "SELECT doc_id, STRLEN(text) AS b FROM documents")
sql("str_char_length", "SELECT doc_id, CHAR_LENGTH(text) AS n FROM documents", "SELECT doc_id, LENGTH(text) AS n FROM documents")
sql("str_concat", "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS STRING) AS s, NULLIF(n_name, 'CHINA') || 'x' AS t FROM nation", "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS VARCHAR) AS s, NULLIF(n_name, 'CHINA') || 'x' AS t FROM nation")
sql("str_substring", "SELECT p_partkey, SUBSTRING(p_name FROM 2 FOR 4) AS a, SUBSTRING(p_name FROM 3) AS b FROM part")
sql("str_position", "SELECT p_partkey, POSITION('a' IN p_name) AS at FROM part")
sql("str_trim_spec", "SELECT TRIM(BOTH 'x' FROM s) AS b, TRIM(LEADING 'x' FROM s) AS l, TRIM(TRAILING 'x' FROM s) AS t FROM (VALUES ('xxabxx'), ('ab')) AS v(s)")
sql("str_overlay", "SELECT n_nationkey, OVERLAY(n_name PLACING '##' FROM 2 FOR 3) AS s FROM nation", "SELECT n_nationkey, SUBSTRING(n_name, 1, 1) || '##' || SUBSTRING(n_name, 5) AS s FROM nation")
sql("str_replace", "SELECT p_partkey, REPLACE(p_name, 'a', '_') AS s FROM part")
sql("str_pad", "SELECT n_nationkey, LPAD(n_name, 12, '.') AS l, RPAD(n_name, 12, '.') AS r FROM nation")
sql("str_left_right", "SELECT n_nationkey, LEFT(n_name, 3) AS l, RIGHT(n_name, 3) AS r FROM nation")
sql("regexp_replace_all", "SELECT p_partkey, REGEXP_REPLACE(p_name, '[aeiou]', '*') AS s FROM part", "SELECT p_partkey, REGEXP_REPLACE(p_name, '[aeiou]', '*', 'g') AS s FROM part")
sql("regexp_substr", "SELECT p_partkey, REGEXP_SUBSTR(p_brand, '[0-9]+') AS s FROM part", "SELECT p_partkey, NULLIF(REGEXP_EXTRACT(p_brand, '[0-9]+'), '') AS s FROM part")
sql("regexp_count", "SELECT p_partkey, REGEXP_COUNT(p_name, '[aeiou]') AS n FROM part", "SELECT p_partkey, CAST(LEN(REGEXP_EXTRACT_ALL(p_name, '[aeiou]')) AS INT) AS n FROM part")
sql("regexp_instr", "SELECT p_partkey, REGEXP_INSTR(p_brand, '[0-9]') AS at FROM part", "SELECT p_partkey, CAST(CASE WHEN REGEXP_MATCHES(p_brand, '[0-9]') THEN LENGTH(REGEXP_EXTRACT(p_brand, '^[^0-9]*')) + 1 ELSE 0 END AS INT) AS at FROM part")
sql("math_abs_round_floor_ceil_sqrt", "SELECT c_custkey, ABS(c_acctbal) AS a, ROUND(c_acctbal, 1) AS r, CAST(FLOOR(c_acctbal) AS BIGINT) AS f, CAST(CEIL(c_acctbal) AS BIGINT) AS c, ROUND(SQRT(ABS(c_acctbal)), 4) AS q FROM customer")
sql("json_field", "SELECT event_id, GET_JSON_OBJECT(props, '$.k') AS k FROM events", "SELECT event_id, JSON_EXTRACT_STRING(props, '$.k') AS k FROM events")
sql("decimal_arith", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS DECIMAL(10,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(16,4)) AS t FROM lineitem")


@frame("SELECT s, TRIM(s, ' \t\n') AS t FROM (VALUES (E' \\t a b\\n'), ('c')) AS v(s)")
def str_trim_ws(spark, sf_dir):
    return spark.createDataFrame([(" \t a b\n",), ("c",)], "s string").select("s", D.trim_space("s").alias("t"))


@frame("SELECT s, LOWER(s) IN ('true', 't', '1') AS b FROM (VALUES ('True'), ('t'), ('1'), ('no'), (NULL)) AS v(s)")
def cast_bool(spark, sf_dir):
    return spark.createDataFrame([("True",), ("t",), ("1",), ("no",), (None,)], "s string").select("s", D.cast_bool("s").alias("b"))


PATTERNS = "(VALUES ('ends', '%A'), ('has', '%ND%'), ('four', '____')) AS p(rule, pat)"


def _patterns(spark, rows):
    return spark.createDataFrame(rows, "rule string, pat string")


@frame(f"SELECT n_nationkey, rule FROM nation JOIN {PATTERNS} ON n_name LIKE pat")
def revlike(spark, sf_dir):
    rules = _patterns(spark, [("ends", "%A"), ("has", "%ND%"), ("four", "____")])
    return table(spark, sf_dir, "nation").join(rules, D.revlike("n_name", "pat")).select("n_nationkey", "rule")


@frame("SELECT n_nationkey, rule FROM nation JOIN (VALUES ('ends', '%a'), ('has', '%Nd%')) AS p(rule, pat) ON n_name ILIKE pat")
def revilike(spark, sf_dir):
    return table(spark, sf_dir, "nation").join(_patterns(spark, [("ends", "%a"), ("has", "%Nd%")]), D.revilike("n_name", "pat")).select("n_nationkey", "rule")


@frame("SELECT n_nationkey, rule FROM nation JOIN (VALUES ('v', '^[AEIOU]'), ('n', 'N$')) AS p(rule, pat) ON REGEXP_MATCHES(n_name, pat)")
def revregexp(spark, sf_dir):
    return table(spark, sf_dir, "nation").join(_patterns(spark, [("v", "^[AEIOU]"), ("n", "N$")]), D.revregexp("n_name", "pat")).select("n_nationkey", "rule")


@frame("SELECT p_partkey FROM part WHERE REGEXP_MATCHES(p_type, '^(?:.*(STEEL|BRASS))$', 's')")
def similar_to(spark, sf_dir):
    return table(spark, sf_dir, "part").where(D.similar_to("p_type", "%(STEEL|BRASS)")).select("p_partkey")


@frame("SELECT s, e, s = 'a.b*c' AS same FROM (VALUES ('a.b*c', 'a\\.b\\*c')) AS v(s, e)")
def create_regex(spark, sf_dir):
    d = spark.createDataFrame([("a.b*c",)], "s string").withColumn("e", D.create_regex("s"))
    return d.select("s", "e", F.expr("s rlike e").alias("same"))


@frame("SELECT p_partkey, REGEXP_REPLACE(p_name, '[aeiou]', '*') AS one, REGEXP_REPLACE(p_name, '[AEIOU]', '*', 'gi') AS every FROM part")
def regex_replace_flags(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", D.regex_replace("p_name", "[aeiou]", "*").alias("one"), D.regex_replace("p_name", "[AEIOU]", "*", "gi").alias("every"))


@frame("SELECT doc_id FROM documents WHERE REGEXP_MATCHES(LOWER(text), '(^|[^a-z0-9_])(the|und)([^a-z0-9_]|$)')")
def text_match_natural(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(D.match_any("text", "the und")).select("doc_id")


@frame("SELECT doc_id FROM documents WHERE REGEXP_MATCHES(LOWER(text), '(^|[^a-z0-9_])the([^a-z0-9_]|$)') AND NOT REGEXP_MATCHES(LOWER(text), '(^|[^a-z0-9_])idiot([^a-z0-9_]|$)')")
def text_match_boolean(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(D.match_boolean("text", "+the -idiot")).select("doc_id")


@frame("SELECT source, COALESCE(MIN(CASE WHEN lang = 'de' THEN doc_id END), MIN(CASE WHEN lang = 'en' THEN doc_id END)) AS doc FROM documents GROUP BY source")
def locale_text(spark, sf_dir):
    least = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("d"))
    by = least.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "d"))).alias("m"))
    return by.select("source", D.locale_text("m", "de", "en").alias("doc"))
