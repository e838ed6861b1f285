"""Queries through the dialect and the table engine; what they write goes to a folder of its own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from lodestar.plans import dialect
from lodestar.queries import frame
from lodestar.session import table, with_tables
from lodestar.sources.tables import Column, Engine
from lodestar.streaming.windows import tumbling_counts


def _dialect(name: str, text: str, oracle: str) -> None:
    def run(spark, sf_dir):
        return dialect.query(with_tables(spark, sf_dir, text), text)

    run.__name__ = name
    frame(oracle)(run)


_dialect("view_as_basic", "SELECT l_orderkey, l_quantity, l_tax FROM lineitem WHERE l_quantity > 45 VIEW AS (l_orderkey AS id, l_quantity * 2 AS twice)", "SELECT l_orderkey AS id, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity > 45")
_dialect("view_as_case", "SELECT p_partkey, p_size FROM part VIEW AS (p_partkey AS id, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size)", "SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size FROM part")
_dialect("dialect_revlike", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON r_name REVLIKE n_name", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_name LIKE r_name")
_dialect("dialect_like_any", "SELECT p_partkey FROM part WHERE p_name LIKE ANY ['%a', 'b%']", "SELECT p_partkey FROM part WHERE p_name LIKE '%a' OR p_name LIKE 'b%'")
_dialect("dialect_similar", "SELECT p_partkey FROM part WHERE p_type NOT SIMILAR TO '%(STEEL|BRASS)'", "SELECT p_partkey FROM part WHERE NOT REGEXP_MATCHES(p_type, '(STEEL|BRASS)$')")
_dialect("dialect_length", "SELECT doc_id, LENGTH(text) AS b FROM documents", "SELECT doc_id, STRLEN(text) AS b FROM documents")
_dialect("dialect_int_div", "SELECT r_regionkey, 7 / 2 AS q FROM region", "SELECT r_regionkey, CAST(3 AS BIGINT) AS q FROM region")
_dialect("dialect_match", "SELECT doc_id FROM documents WHERE MATCH(text) AGAINST('+the -idiot' IN BOOLEAN MODE)", "SELECT doc_id FROM documents WHERE REGEXP_MATCHES(LOWER(text), '(^|[^a-z0-9_])the([^a-z0-9_]|$)') AND NOT REGEXP_MATCHES(LOWER(text), '(^|[^a-z0-9_])idiot([^a-z0-9_]|$)')")
_dialect("dialect_filter_by", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey FILTER BY n_regionkey = 2 WHERE c_acctbal > 0", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND c_acctbal > 0")
_dialect("dialect_regex_ops", "SELECT p_partkey FROM part WHERE p_type ~* '^small' AND p_brand !~ '5$'", "SELECT p_partkey FROM part WHERE REGEXP_MATCHES(p_type, '^small', 'i') AND NOT REGEXP_MATCHES(p_brand, '5$')")


def _engine(spark) -> Engine:
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return Engine(spark, f"{shared}/lodestar/tables-{uuid.uuid4().hex}" if shared else f"file://{tempfile.mkdtemp(prefix='lodestar-')}")


def _geography(spark, sf_dir, on_delete: str = "restrict") -> Engine:
    """region <- nation <- supplier, with references by objid."""
    e = _engine(spark)
    e.create_table("regions", [("code", "int"), ("name", "text")])
    e.insert("regions", table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("name")))
    ids = e.read("regions").select(F.col("code").alias("r_code"), F.col("objid").alias("region_ref"))
    e.create_table("nations", [("code", "int"), ("name", "text"), Column("region_ref", "bigint", True, "regions", on_delete)])
    e.insert("nations", table(spark, sf_dir, "nation").join(ids, F.col("n_regionkey") == F.col("r_code")).select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), "region_ref"))
    ids = e.read("nations").select(F.col("code").alias("n_code"), F.col("objid").alias("nation_ref"))
    e.create_table("suppliers", [("code", "bigint"), Column("nation_ref", "bigint", True, "nations", on_delete)])
    e.insert("suppliers", table(spark, sf_dir, "supplier").join(ids, F.col("s_nationkey") == F.col("n_code")).select(F.col("s_suppkey").alias("code"), "nation_ref"))
    return e


@frame("SELECT s_suppkey AS code, n_name AS nation_ref_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def ref_one_hop(spark, sf_dir):
    return _geography(spark, sf_dir).navigate("suppliers", "nation_ref.name").select("code", "nation_ref_name")


@frame("SELECT s_suppkey AS code, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def ref_two_hop(spark, sf_dir):
    return _geography(spark, sf_dir).navigate("suppliers", "nation_ref.region_ref.name").select("code", F.col("nation_ref_region_ref_name").alias("region"))


@frame("SELECT s_suppkey AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name LIKE 'C%'")
def ref_filter_by(spark, sf_dir):
    return _geography(spark, sf_dir).navigate("suppliers", "nation_ref.name").where("nation_ref_name LIKE 'C%'").select("code")


@frame("SELECT s_suppkey AS code, n_nationkey AS nation, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def ref_expand(spark, sf_dir):
    return _geography(spark, sf_dir).expand("suppliers", "nation_ref", "n").select("code", F.col("n.code").alias("nation"), F.col("n.name").alias("name"))


@frame("SELECT n_nationkey AS code, COUNT(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def virtual_ref_array(spark, sf_dir):
    return _geography(spark, sf_dir).referencing("nations", "suppliers", "nation_ref", "s").select("code", F.coalesce(F.size("s"), F.lit(0)).cast("long").alias("n"))


@frame("SELECT s_suppkey AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 1")
def ref_cascade(spark, sf_dir):
    e = _geography(spark, sf_dir, "cascade")
    e.delete("regions", "code = 1")
    return e.read("suppliers").select("code")


@frame("SELECT n_nationkey AS code, n_regionkey = 1 AS orphan FROM nation")
def ref_set_null(spark, sf_dir):
    e = _geography(spark, sf_dir, "set null")
    e.delete("regions", "code = 1")
    return e.read("nations").select("code", F.col("region_ref").isNull().alias("orphan"))


def _customers(spark, sf_dir) -> Engine:
    e = _engine(spark)
    e.create_table("c", [("id", "bigint"), ("balance", "double"), ("segment", "text")], versioned=True, unique=[["id"]])
    e.insert("c", table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")))
    return e


@frame("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT -1, NULL, 'NEW'")
def dml_insert_readback(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.insert("c", [{"id": -1, "segment": "NEW"}])
    return e.read("c").drop("objid")


@frame("SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS balance FROM customer")
def dml_update_where(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.update("c", {"balance": 0.0}, "segment = 'BUILDING'")
    return e.read("c").select("id", "balance")


@frame("SELECT c_custkey AS id FROM customer WHERE NOT c_acctbal < 0")
def dml_delete_where(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.delete("c", "balance < 0")
    return e.read("c").select("id")


@frame("SELECT c_custkey AS id, c_acctbal AS balance FROM customer")
def version_as_of(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.update("c", {"balance": 1.0})
    return e.read("c", version=1).select("id", "balance")


@frame("SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE c_acctbal END AS balance FROM customer")
def version_latest(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.update("c", {"balance": 7.0}, "segment = 'BUILDING'")
    e.update("c", {"balance": 1.0}, "segment = 'BUILDING'")
    return e.sql("SELECT id, balance FROM c")


@frame(
    "SELECT c_custkey AS id, c_acctbal AS balance, 1 AS valid_from, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 2 END AS INT) AS valid_to FROM customer"
    " UNION ALL SELECT c_custkey, -1.0, 2, CAST(3 AS INT) FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, c_acctbal, 3, NULL FROM customer WHERE c_mktsegment = 'BUILDING'"
)
def version_history(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.execute("UPDATE c SET balance = -1.0 WHERE segment = 'BUILDING'")
    back = e.read("c", 1).select(F.col("id").alias("k"), F.col("balance").alias("b"))
    e._write("c", e.read("c").join(back, F.col("id") == F.col("k")).withColumn("balance", F.col("b")).drop("k", "b"))
    return e.sql("SELECT id, balance, valid_from, valid_to FROM c FOR SYSTEM_TIME ALL")


@frame("SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal > 0")
def version_sql_as_of(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.execute("DELETE FROM c; ")
    return e.sql("SELECT h.id, h.balance FROM c h FOR SYSTEM_TIME AS OF 1 WHERE h.balance > 0")


_dialect("dialect_int_div_columns", "SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS q, l_orderkey * 2 / 3 / 2 AS r, -l_orderkey / 7 AS n, l_extendedprice / 2 AS f FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(TRUNC(l_orderkey / 7) AS BIGINT) AS q, CAST(TRUNC(TRUNC(l_orderkey * 2 / 3) / 2) AS BIGINT) AS r, CAST(TRUNC(-l_orderkey / 7) AS BIGINT) AS n, l_extendedprice / 2 AS f FROM lineitem")
_dialect("dialect_any_subquery", "SELECT p_partkey FROM part WHERE p_size = ANY (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)", "SELECT p_partkey FROM part WHERE p_size IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
_dialect("dialect_all_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > ALL (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P')", "SELECT o_orderkey FROM orders WHERE o_totalprice > ALL (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P')")
_dialect("dialect_group_concat", "SELECT n_regionkey, GROUP_CONCAT(n_name, ';') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, STRING_AGG(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_dialect("dialect_regex_replace", "SELECT p_partkey, REGEX_REPLACE(p_name, '[aeiou]', '*') AS one, REGEX_REPLACE(p_name, '[AEIOU]', '*', 'gi') AS every, CREATE_REGEX(p_brand) AS r FROM part", "SELECT p_partkey, REGEXP_REPLACE(p_name, '[aeiou]', '*') AS one, REGEXP_REPLACE(p_name, '[AEIOU]', '*', 'gi') AS every, REPLACE(p_brand, '#', '\\#') AS r FROM part")
_dialect("dialect_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20, 7", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 20")
_dialect("dialect_unnest", "SELECT vec_id, UNNEST(embedding) AS x FROM embeddings WHERE vec_id < 20", "SELECT vec_id, UNNEST(embedding) AS x FROM embeddings WHERE vec_id < 20")
_dialect("dialect_substring_regex", "SELECT p_partkey, SUBSTRING(p_brand FROM '[0-9]+') AS d FROM part", "SELECT p_partkey, NULLIF(REGEXP_EXTRACT(p_brand, '[0-9]+'), '') AS d FROM part")
_dialect("dialect_cast_boolean", "SELECT p_partkey, CAST(p_size % 2 AS BOOLEAN) AS odd, CAST(p_name AS BOOLEAN) AS t FROM part", "SELECT p_partkey, p_size % 2 <> 0 AS odd, LOWER(p_name) IN ('true', 't', '1') AS t FROM part")
_dialect("dialect_revregexp_fold", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON r_name REVREGEXP* n_name", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON REGEXP_MATCHES(n_name, r_name, 'i')")
_dialect("cube_extra", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)")
_dialect("intersect_except_extra", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
_dialect("agg_filter_extra", "SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_totalprice > 100000) AS big, COUNT(*) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_totalprice > 100000) AS big, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
_dialect("cte_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")


def _loaded(spark, sf_dir, ddl: str, name: str, source: str, query: str) -> Engine:
    """An engine with a table made by a statement and filled by INSERT .. SELECT from a test table."""
    e = _engine(spark)
    table(spark, sf_dir, source).createOrReplaceTempView(source)
    e.execute(f"{ddl}; INSERT INTO {name} {query}")
    return e


ORDERS = "CREATE TABLE o (id BIGINT PRIMARY KEY, price DOUBLE NOT NULL, status VARCHAR(1) DEFAULT 'N', CHECK (id > -10))"


@frame("SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status FROM orders UNION ALL SELECT -1, 2.5, 'N' UNION ALL SELECT -2, 3.5, 'X'")
def dml_sql_insert(spark, sf_dir):
    e = _loaded(spark, sf_dir, ORDERS, "o", "orders", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
    e.execute("INSERT INTO o (id, price) VALUES (-1, 2.5); INSERT INTO app.o VALUES (-2, 3.5, 'X')")
    return e.sql("SELECT id, price, status FROM app.o")


@frame("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS price, CASE WHEN o_orderstatus = 'F' THEN 'N' ELSE o_orderstatus END AS status FROM orders")
def dml_sql_update(spark, sf_dir):
    e = _loaded(spark, sf_dir, ORDERS, "o", "orders", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
    e.execute("UPDATE o SET price = price * 2, status = DEFAULT WHERE status = 'F'")
    return e.sql("SELECT id, price, status FROM o")


@frame("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice >= 50000")
def dml_sql_delete(spark, sf_dir):
    e = _loaded(spark, sf_dir, ORDERS, "o", "orders", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
    e.execute("DELETE FROM o WHERE status = 'F'; DELETE FROM o WHERE price < 50000")
    return e.sql("SELECT id FROM o")


@frame("SELECT p_partkey AS id, p_size AS n, CAST(NULL AS VARCHAR) AS note FROM part")
def ddl_sql_alter(spark, sf_dir):
    e = _loaded(spark, sf_dir, "CREATE TABLE p (id BIGINT, size INT, label TEXT)", "p", "part", "SELECT p_partkey, p_size, p_name FROM part")
    e.execute("ALTER TABLE p ADD COLUMN note TEXT; ALTER TABLE p RENAME COLUMN size TO n; ALTER TABLE p DROP COLUMN label; ALTER TABLE p RENAME TO q")
    return e.sql("SELECT id, n, note FROM q")


@frame("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'")
def txn_sql_nested(spark, sf_dir):
    e = _loaded(spark, sf_dir, ORDERS, "o", "orders", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
    e.execute("BEGIN TRANSACTION a; DELETE FROM o WHERE status = 'P'; SAVEPOINT s; DELETE FROM o WHERE status = 'F'; ROLLBACK TO SAVEPOINT s; BEGIN TRANSACTION b; DELETE FROM o; ROLLBACK TRANSACTION b; COMMIT TRANSACTION a")
    return e.sql("SELECT id FROM o")


@frame("SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
def materialized_view(spark, sf_dir):
    e = _loaded(spark, sf_dir, ORDERS, "o", "orders", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
    e.execute("CREATE MATERIALIZED VIEW m AS SELECT status, COUNT(*) AS n FROM o GROUP BY status; DELETE FROM o")
    return e.sql("SELECT status, n FROM m")


@frame("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS status FROM orders")
def enum_name(spark, sf_dir):
    e = _loaded(spark, sf_dir, "CREATE ENUM state ('done', 'open', 'partial'); CREATE TABLE o (id BIGINT, status state)", "o", "orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'OPEN' ELSE 'partial' END FROM orders")
    return e.sql("SELECT id, status FROM o").select("id", e.enum_names("state", "status").alias("status"))


@frame("SELECT p_partkey AS id, p_size % 8 AS bits, CONCAT_WS('|', CASE WHEN p_size & 1 <> 0 THEN 'read' END, CASE WHEN p_size & 2 <> 0 THEN 'write' END, CASE WHEN p_size & 4 <> 0 THEN 'admin' END, CASE WHEN p_size % 8 = 0 THEN 'NONE' END) AS names FROM part")
def flag_enum_mask(spark, sf_dir):
    e = _loaded(spark, sf_dir, "CREATE ENUM FLAG perm (NONE, 'read', 'write', 'admin'); CREATE TABLE p (id BIGINT, bits perm)", "p", "part", "SELECT p_partkey, p_size % 8 FROM part")
    return e.sql("SELECT id, bits FROM p").select("id", F.col("bits").cast("int").alias("bits"), e.enum_names("perm", "bits").alias("names"))


@frame("SELECT s_suppkey AS code, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_name LIKE '%A%'")
def ref_sql_path(spark, sf_dir):
    return _geography(spark, sf_dir).sql("SELECT s.code, s.nation_ref.region_ref.name AS region FROM suppliers s FILTER BY s.nation_ref.name LIKE '%A%'")


@frame("SELECT s_suppkey AS supplier, n_nationkey AS code, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def ref_sql_expand(spark, sf_dir):
    return _geography(spark, sf_dir).sql("SELECT s.code, EXPAND(s.nation_ref) AS n FROM suppliers s VIEW AS (code AS supplier, n.code AS code, n.name AS name)")


@frame("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey BETWEEN 100 AND 300")
def index_bulk_load(spark, sf_dir):
    e = _loaded(spark, sf_dir, ORDERS, "o", "orders", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_totalprice")
    e.execute("CREATE UNIQUE INDEX by_id ON o USING BTREE (id)")
    return e.sql("SELECT id, price FROM o WHERE id BETWEEN 100 AND 300")


@frame("SELECT DATE_TRUNC('hour', ts) AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_extra(spark, sf_dir):
    return tumbling_counts(table(spark, sf_dir, "events"))
