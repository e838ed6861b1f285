import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestar.functions import dialect as D
from lodestar.operators import relational as R
from lodestar.plans import dialect, errors
from lodestar.sources.tables import Column, Engine, spark_type


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_insert_fills_nulls_and_survives_reopening(spark, engine):
    engine.create_table("t", [("id", "int", False), ("v", "text")])
    assert engine.insert("t", [{"id": 1}, {"id": 2, "v": "x"}]) == 2
    again = Engine(spark, engine.folder)
    assert rows(again.read("t").fillna("-"), "objid", "id", "v") == [(1, 1, "-"), (2, 2, "x")]
    again.insert("t", [{"id": 3}])
    assert rows(again.read("t"), "objid") == [(1,), (2,), (3,)]
    with pytest.raises(errors.NullConstraintViolation):
        engine.insert("t", [{"v": "y"}])


def test_constraints(engine):
    engine.create_table("t", [("id", "int unsigned"), ("m", "mediumint")], unique=[["id"]], checks=["id < 10"])
    engine.insert("t", [{"id": 1, "m": 5}])
    for bad in ({"id": 1}, {"id": -1}, {"id": 10}, {"id": 2, "m": 9_000_000}):
        with pytest.raises(errors.ConstraintViolation):
            engine.insert("t", [bad])
    assert engine.read("t").count() == 1
    with pytest.raises(errors.ConstraintViolation):
        engine.insert("t", [{"objid": 7}])


def test_grants(engine):
    engine.create_table("t", [("id", "int")])
    engine.user = "ann"
    with pytest.raises(errors.PermissionDenied):
        engine.insert("t", [{"id": 1}])
    engine.user = "root"
    engine.grant("ann", "t", "INSERT")
    engine.user = "ann"
    assert engine.insert("t", [{"id": 1}]) == 1
    with pytest.raises(errors.PermissionDenied):
        engine.delete("t")


def test_references(engine):
    engine.create_table("p", [("k", "int")])
    engine.insert("p", [{"k": 1}, {"k": 2}])
    engine.create_table("c", [("k", "int"), Column("p_ref", "bigint", True, "p")])
    with pytest.raises(errors.ReferentialIntegrityViolation):
        engine.insert("c", [{"k": 1, "p_ref": 99}])
    engine.insert("c", [{"k": 1, "p_ref": 1}, {"k": 2}])
    with pytest.raises(errors.ReferentialIntegrityViolation):
        engine.delete("p", "k = 1")
    assert engine.delete("p", "k = 2") == 1
    assert rows(engine.navigate("c", "p_ref.k").fillna(-1), "k", "p_ref_k") == [(1, 1), (2, -1)]


def test_enums(engine):
    engine.create_enum("perm", ["NONE", "READ", "WRITE"], flag=True)
    engine.create_table("f", [("a", "perm")])
    engine.insert("f", [{"a": 3}, {"a": 0}, {"a": None}])
    assert sorted(map(str, (r[0] for r in engine.read("f").select(engine.enum_names("perm", "a")).collect()))) == ["NONE", "None", "READ|WRITE"]
    with pytest.raises(errors.ConstraintViolation):
        engine.insert("f", [{"a": 4}])
    with pytest.raises(errors.TypeInUse):
        engine.drop_enum("perm")
    assert engine.enum_value("perm", "write") == 2
    with pytest.raises(errors.InvalidEnumValue):
        engine.create_enum("bad", ["A", "a"])


def test_transactions_are_last_in_first_out(engine):
    engine.create_table("t", [("id", "int")])
    engine.begin("outer")
    engine.insert("t", [{"id": 1}])
    engine.savepoint("s")
    engine.insert("t", [{"id": 2}])
    engine.rollback_to("s")
    engine.begin("inner")
    with pytest.raises(errors.TransactionError):
        engine.commit("outer")
    with pytest.raises(errors.TransactionError):
        engine.begin("inner")
    engine.insert("t", [{"id": 3}])
    engine.rollback("inner")
    engine.commit("outer")
    assert rows(engine.read("t"), "id") == [(1,)]
    with pytest.raises(errors.TransactionError):
        engine.commit()


def test_versions(engine):
    engine.create_table("t", [("id", "int")], versioned=True)
    engine.insert("t", [{"id": 1}])
    engine.update("t", {"id": 2})
    engine.delete("t")
    assert rows(engine.read("t", 1), "id") == [(1,)] and engine.read("t").count() == 0
    assert rows(engine.history("t"), "id", "valid_from", "valid_to") == [(1, 1, 2), (2, 2, 3)]


def test_alter(engine):
    engine.create_table("t", [("id", "int"), ("v", "text")])
    engine.insert("t", [{"id": 1, "v": "a"}])
    engine.alter("t", add=Column("w", "int"))
    engine.alter("t", rename=("v", "x"))
    engine.alter("t", drop="id")
    engine.alter("t", to="u")
    assert engine.read("u").columns == ["objid", "x", "w"]


def test_flat_tables_do_not_join(engine):
    for n, flat in (("a", True), ("b", False)):
        engine.create_table(n, [("id", "int")], flat=flat)
        engine.insert(n, [{"id": 1}])
    with pytest.raises(errors.FlatTableJoin):
        engine.sql("SELECT * FROM b JOIN a ON a.id = b.id")
    assert engine.sql("SELECT id FROM a").count() == 1


@pytest.mark.parametrize("text", ["SELECT 1 FROM a NATURAL JOIN b", "SELECT 1 FROM a JOIN b USING (id)"])
def test_refused_joins(text):
    with pytest.raises(errors.UnsupportedFeature):
        dialect.rewrite(text)


def test_front_end():
    with pytest.raises(errors.InvalidAggregateUsage):
        dialect.rewrite("SELECT a FROM t WHERE COUNT(*) > 1")
    dialect.rewrite("SELECT a FROM t WHERE a > (SELECT AVG(a) FROM t)")
    for bad in ("SELECT a FROM t VIEW AS (SUM(a) AS s)", "SELECT a FROM t VIEW AS ((SELECT 1) AS s)"):
        with pytest.raises(errors.ViewAsNotAllowed):
            dialect.rewrite(bad)
    with pytest.raises(errors.CrossDatabaseJoin):
        dialect.rewrite("SELECT 1 FROM a JOIN b ON a.x = b.x", {"a": dialect.TableFacts("d1"), "b": dialect.TableFacts("d2")})
    assert dialect.statements("SELECT ';'; -- x;\nSELECT 2;") == ["SELECT ';'", "SELECT 2"]


def test_types():
    assert spark_type("[varchar(3)]") == "array<string>" and spark_type("BIGINT UNSIGNED") == "decimal(20,0)" and spark_type("decimal(8,2)") == "decimal(8,2)"
    for bad in ("FLOAT UNSIGNED", "ENUM('a')"):
        with pytest.raises(errors.UnsupportedFeature):
            spark_type(bad)


def test_operators(spark):
    d = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "id int, a array<int>")
    assert rows(R.unnest(d, "a", "x"), "id", "x") == [(1, 1), (1, 2)]
    assert R.aggregate(d.where("id > 9"), [], [("count", "*", "n"), ("sum", "id", "s")]).collect()[0].asDict() == {"n": 0, "s": None}
    with pytest.raises(errors.UnsupportedFeature):
        R.aggregate(d, [], [("median_ish", "id", "x")])
    with pytest.raises(errors.UnsupportedFeature):
        R.join(d, d, how="asof")
    n = spark.createDataFrame([(5,), (None,), (2,)], "n int")
    assert [r.n for r in R.sort(n, "n").collect()] == [None, 2, 5]
    assert [r.n for r in R.sort(n, ("n", False)).collect()] == [5, 2, None]
    assert R.seq_scan(d, ["id", "zz"]).columns == ["id", "zz"]
    assert R.values(spark, [(1, "a")], ["k"]).columns == ["k", "col_1"]


def test_three_valued_logic(spark):
    q = "SELECT (NULL AND FALSE) IS NULL a, (NULL AND TRUE) IS NULL b, (NULL OR TRUE) c, CASE WHEN FALSE THEN 1 END IS NULL d"
    assert tuple(spark.sql(q).first()) == (False, True, True, True)
    with pytest.raises(PySparkException):
        spark.sql("SELECT 1 / 0").collect()


def test_functions(spark):
    d = spark.createDataFrame([("a.b*c", {"default": "x", "de": "y"}, ["ab", "cd"])], "s string, m map<string,string>, arr array<string>")
    r = d.select(D.regex_replace("s", "[a-c]", "#").alias("one"), D.regex_replace("s", "[A-C]", "#", "gi").alias("all"), D.locale_text("m", "fr", "default").alias("l"), D.any_of(F.lit("ab"), "=", "arr").alias("any"), D.all_of(F.lit("ab"), "LIKE", "arr").alias("every")).first()
    assert tuple(r) == ("#.b*c", "#.#*#", "x", True, False)


def test_lookup_reaches_the_reader(spark, tmp_path):
    R.bulk_load(spark.range(1000).toDF("k"), f"{tmp_path}/k", "k", files=4)
    plan = R.index_scan(spark.read.parquet(f"{tmp_path}/k"), "k = 7")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,7)]" in plan
