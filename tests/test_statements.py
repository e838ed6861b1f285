"""Statements in text, one engine each."""

import pytest
from pyspark.sql import functions as F

from lodestar.plans import dialect, errors
from lodestar.sources.tables import Engine


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_tables_and_rows(engine):
    assert engine.execute("CREATE TABLE t (id INT PRIMARY KEY, v VARCHAR(5) DEFAULT 'd', n INT NOT NULL CHECK (n > 0)); INSERT INTO t (id, n) VALUES (1, 5), (2, 6); INSERT INTO t VALUES (3, 'x', 7), (4, DEFAULT, 8)") == [None, 2, 2]
    assert rows(engine.sql("SELECT id, v FROM t")) == [(1, "d"), (2, "d"), (3, "x"), (4, "d")]
    for bad, error in (("INSERT INTO t VALUES (1, 'a', 1)", errors.ConstraintViolation), ("INSERT INTO t VALUES (9, 'a')", errors.NullConstraintViolation), ("INSERT INTO t VALUES (9, 'a', -1)", errors.ConstraintViolation), ("UPDATE t SET id = 1 WHERE id = 2", errors.ConstraintViolation), ("INSERT INTO t (zz) VALUES (1)", errors.ColumnNotFound), ("UPDATE t SET zz = 1", errors.ColumnNotFound), ("INSERT INTO u VALUES (1)", errors.TableNotFound), ("INSERT t VALUES (1)", errors.DialectSyntaxError), ("FLY t", errors.UnsupportedFeature), ("CREATE TABLE w (a INT, FOREIGN KEY (a) REFERENCES t)", errors.UnsupportedFeature), ("CREATE TABLE w (a INT ON DELETE CASCADE)", errors.ConstraintViolation)):
        with pytest.raises(error):
            engine.execute(bad)
    assert engine.execute("UPDATE t SET v = v || '!', n = n / 2 WHERE id < 3; DELETE FROM t WHERE id = 3") == [2, 1]
    assert rows(engine.sql("SELECT id, v, n FROM t")) == [(1, "d!", 2), (2, "d!", 3), (4, "d", 8)]


def test_only_touched_files_are_written(spark, engine):
    engine.execute("CREATE TABLE t (id INT, v INT); INSERT INTO t VALUES (1, 1); INSERT INTO t VALUES (2, 2); INSERT INTO t VALUES (3, 3)")
    before = set(engine.read("t").inputFiles())
    engine.execute("UPDATE t SET v = 9 WHERE id = 2")
    assert len(before & set(engine.read("t").inputFiles())) == 2 and rows(engine.sql("SELECT id, v FROM t")) == [(1, 1), (2, 9), (3, 3)]
    assert rows(engine.sql("SELECT objid, id FROM t")) == [(1, 1), (2, 2), (3, 3)]
    assert engine.execute("UPDATE t SET v = 0 WHERE id > 9") == [0] and len(engine.get("t").snapshots) == 4


def test_history_has_gaps(engine):
    engine.execute("CREATE TABLE t (id INT, v INT) WITH SYSTEM VERSIONING; INSERT INTO t VALUES (1, 1), (2, 5); UPDATE t SET v = 2 WHERE id = 1; UPDATE t SET v = 1 WHERE id = 1")
    assert rows(engine.sql("SELECT id, v, valid_from, valid_to FROM t FOR SYSTEM_TIME ALL")) == [(1, 1, 1, 2), (1, 1, 3, None), (1, 2, 2, 3), (2, 5, 1, None)]
    assert rows(engine.sql("SELECT v FROM t FOR SYSTEM_TIME AS OF 2 WHERE id = 1")) == [(2,)]
    at = engine.get("t").times[1]
    assert rows(engine.sql(f"SELECT x.v FROM t x FOR SYSTEM_TIME AS OF '{at}' WHERE x.id = 1")) == [(2,)]
    assert rows(engine.sql("SELECT v FROM t FOR SYSTEM_TIME AS OF '2001-01-01'")) == []
    engine.execute("CREATE TABLE u (id INT)")
    with pytest.raises(errors.UnsupportedFeature):
        engine.sql("SELECT * FROM u FOR SYSTEM_TIME ALL")


def test_two_writers_and_reopening(spark, engine):
    engine.execute("CREATE TABLE t (id INT); INSERT INTO t VALUES (1)")
    one, two = Engine(spark, engine.folder), Engine(spark, engine.folder)
    one.execute("INSERT INTO t VALUES (2)")
    with pytest.raises(errors.TransactionError):
        two.execute("INSERT INTO t VALUES (3)")
    assert rows(Engine(spark, engine.folder).sql("SELECT objid, id FROM t")) == [(1, 1), (2, 2)]


def test_grants_by_name_and_column(engine):
    engine.execute("CREATE TABLE e (id INT, pay INT); CREATE TABLE t (id INT); INSERT INTO e VALUES (1, 10); INSERT INTO t VALUES (1); GRANT SELECT ON t TO ann; GRANT SELECT (id), UPDATE (id) ON e TO ann")
    engine.user = "ann"
    assert rows(engine.sql("SELECT id FROM t WHERE id > 0")) == [(1,)]
    assert engine.sql("SELECT * FROM e").columns == ["id"] and engine.execute("UPDATE e SET id = 3") == [1]
    for bad in ("UPDATE e SET pay = 3", "INSERT INTO e VALUES (2, 2)", "DELETE FROM t"):
        with pytest.raises(errors.PermissionDenied):
            engine.execute(bad)
    engine.user = "root"
    engine.execute("REVOKE SELECT ON t FROM ann")
    engine.user = "ann"
    with pytest.raises(errors.PermissionDenied):
        engine.sql("SELECT id FROM t")


def test_transactions(engine):
    engine.execute("CREATE TABLE t (id INT); CREATE TEMP TABLE d (id INT) ON COMMIT DELETE ROWS; CREATE TEMPORARY TABLE x (id INT) ON COMMIT DROP")
    engine.execute("BEGIN; INSERT INTO t VALUES (1); INSERT INTO d VALUES (1); COMMIT AND CHAIN; INSERT INTO t VALUES (2); SAVEPOINT s; RELEASE SAVEPOINT s; ROLLBACK")
    assert rows(engine.sql("SELECT id FROM t")) == [(1,)] and engine.sql("SELECT * FROM d").count() == 0 and "x" not in engine.tables
    engine.execute("START TRANSACTION ISOLATION LEVEL SERIALIZABLE, READ ONLY")
    with pytest.raises(errors.TransactionError):
        engine.execute("INSERT INTO t VALUES (5)")
    engine.execute("ROLLBACK; BEGIN TRANSACTION a; BEGIN TRANSACTION b; INSERT INTO t VALUES (7); COMMIT ALL")
    assert rows(engine.sql("SELECT id FROM t")) == [(1,), (7,)] and not engine.stack
    with pytest.raises(errors.TransactionError):
        engine.execute("ROLLBACK TO SAVEPOINT s")


def test_names_types_views_indexes(engine):
    engine.execute("CREATE DATABASE shop; CREATE SCHEMA s; CREATE USER ann; USE shop; CREATE TABLE a (id INT); USE app; CREATE TABLE b (id INT); INSERT INTO shop.s.a VALUES (1); INSERT INTO b VALUES (1)")
    assert rows(engine.sql("SELECT a.id FROM shop.s.a")) == [(1,)]
    for bad in ("SELECT 1 FROM shop.a JOIN b ON a.id = b.id", "SELECT 1 FROM a, b WHERE a.id = b.id"):
        with pytest.raises(errors.CrossDatabaseJoin):
            engine.sql(bad)
    with pytest.raises(errors.TableNotFound):
        engine.sql("SELECT 1 FROM app.a")
    with pytest.raises(errors.ConstraintViolation):
        engine.execute("DROP DATABASE shop")
    engine.execute("CREATE TYPE place AS (street TEXT, no INT); CREATE TYPE mood AS ENUM ('low', 'high'); CREATE TABLE c (p place, m mood); INSERT INTO c VALUES (named_struct('street', 'x', 'no', 3), 'HIGH')")
    assert rows(engine.sql("SELECT p.street, p.no, m FROM c")) == [("x", 3, 1)]
    for bad, error in (("INSERT INTO c (m) VALUES ('none')", errors.ConstraintViolation), ("DROP TYPE place", errors.TypeInUse), ("CREATE ENUM mood ('a')", errors.TypeExists)):
        with pytest.raises(error):
            engine.execute(bad)
    engine.execute("CREATE VIEW v AS SELECT id + 1 AS k FROM b; CREATE MATERIALIZED VIEW m AS SELECT COUNT(*) AS n FROM b; INSERT INTO b VALUES (2)")
    assert rows(engine.sql("SELECT k FROM v")) == [(2,), (3,)] and rows(engine.sql("SELECT n FROM m")) == [(1,)]
    engine.execute("REFRESH MATERIALIZED VIEW m; CREATE INDEX i ON b (id)")
    assert rows(engine.sql("SELECT n FROM m")) == [(2,)] and engine.get("b").indexes["i"] == {"columns": ["id"], "kind": "btree"}
    engine.execute("DROP INDEX i; DROP VIEW v; DROP MATERIALIZED VIEW m; DROP TABLE IF EXISTS zz; DROP TABLE c; DROP TYPE place; DROP TYPE mood; DROP USER ann")
    assert "Scan parquet" in engine.execute("EXPLAIN SELECT id FROM b WHERE id = 1")[0].first()[0]
    with pytest.raises(errors.TableNotFound):
        engine.execute("DROP INDEX i")


def test_references_in_text(engine):
    engine.execute("CREATE TABLE p (name TEXT); CREATE TABLE c (k INT, p_ref p REFERENCES p ON DELETE SET NULL); CREATE TABLE g (many [c]); INSERT INTO p VALUES ('a'), ('b'); INSERT INTO c VALUES (1, 1), (2, 2), (3, NULL); INSERT INTO g VALUES (array(1L, 2L))")
    assert rows(engine.sql("SELECT c.k, c.p_ref.name AS n FROM c")) == [(1, "a"), (2, "b"), (3, None)]
    assert rows(engine.sql("SELECT x.k FROM c AS x FILTER BY x.p_ref.name = 'b'")) == [(2,)]
    assert rows(engine.sql("SELECT x.k, EXPAND(x.p_ref) AS e FROM c x WHERE x.k < 3")) == [(1, 1, "a"), (2, 2, "b")]
    assert rows(engine.sql("SELECT EXPAND(many) AS e FROM g VIEW AS (e.k AS k)")) == [(1,), (2,)]
    with pytest.raises(errors.InvalidExpand):
        engine.sql("SELECT EXPAND(x.k) FROM c x")
    engine.execute("DELETE FROM p WHERE name = 'a'")
    assert rows(engine.sql("SELECT k, p_ref FROM c")) == [(1, None), (2, 2), (3, None)]
    with pytest.raises(errors.ReferentialIntegrityViolation):
        engine.execute("DROP TABLE p")


def test_flat_tables_and_inheritance(engine):
    engine.execute("CREATE TABLE a (id INT UNIQUE); CREATE TABLE b (v INT) INHERITS (a); CREATE FLAT TABLE f (id INT); INSERT INTO f VALUES (1); INSERT INTO b VALUES (1, 2)")
    assert engine.sql("SELECT * FROM f").columns == ["id"] and rows(engine.sql("SELECT id, v FROM b")) == [(1, 2)]
    for bad in ("SELECT 1 FROM f, b WHERE f.id = b.id", "SELECT 1 FROM b JOIN f ON f.id = b.id"):
        with pytest.raises(errors.FlatTableJoin):
            engine.sql(bad)
    for bad in ("CREATE FLAT TABLE h (id INT) VERSIONED", "CREATE FLAT TABLE h (id INT) INHERITS (a)"):
        with pytest.raises(errors.ConstraintViolation):
            engine.execute(bad)


def test_refused_text():
    for bad in ("SELECT a FROM t ORDER BY ALL", "SELECT a FROM t WHERE MATCH(a) AGAINST('x' WITH QUERY EXPANSION)"):
        with pytest.raises(errors.UnsupportedFeature):
            dialect.rewrite(bad)


def test_delete_that_fails_changes_nothing(engine):
    engine.execute("CREATE TABLE p (k INT); CREATE TABLE a (r p REFERENCES p ON DELETE CASCADE); CREATE TABLE b (r p REFERENCES p); INSERT INTO p VALUES (1); INSERT INTO a VALUES (1); INSERT INTO b VALUES (1)")
    with pytest.raises(errors.ReferentialIntegrityViolation):
        engine.execute("DELETE FROM p")
    assert engine.read("a").where(F.col("r") == 1).count() == 1 and not engine.stack
