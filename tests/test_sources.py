"""Ingest, splitting, views, bounded queries, logs and the streaming wrapper."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators.detection import Context, detect
from plumbline.operators.key_store import write_key_store
from plumbline.plans.closed_loop import run_pipeline
from plumbline.operators.profile_store import read_profiles
from plumbline.plans.profile_dataset import profile_dataset
from plumbline.sources import logs
from plumbline.sources import tables as source
from plumbline.streaming.batches import watch


@pytest.fixture(scope="module")
def csv_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    lines = ["id,price,note,flag,day,code"]
    for i in range(100):
        note = f'"line one\nline, {i}"' if i % 10 == 0 else f"plain {i}"
        price = "NA" if i == 7 else f"{i}.5"
        lines.append(f"{i},{price},{note},{'True' if i % 2 else 'False'},2020-01-{i % 28 + 1:02d},{i if i != 3 else ''}")
    (folder / "stays.v2.csv").write_text("\n".join(lines) + "\n")
    (folder / "plain.csv").write_text("k,v\n" + "".join(f"{i},x{i}\n" for i in range(50)))
    return str(folder)


def test_ingest(spark, csv_folder, tmp_path):
    names = source.ingest(spark, csv_folder, str(tmp_path), columns={"plain": ["k"]})
    assert sorted(names) == ["plain", "stays"]
    clean, test = source.load_tables(spark, str(tmp_path), "clean"), source.load_tables(spark, str(tmp_path), "test")
    assert (clean["stays"].count(), test["stays"].count()) == (97, 3)
    assert clean["plain"].columns == ["k", "row_id"]
    types = dict(clean["stays"].dtypes)
    assert types["id"] == "bigint" and types["price"] == "double" and types["flag"] == "boolean" and types["code"] == "bigint"
    assert types["day"] == "string" and clean["stays"].filter("price IS NULL").count() == 1
    assert clean["stays"].filter(F.contains("note", F.lit("\n"))).count() == 10
    assert [r["id"] for r in test["stays"].orderBy("row_id").collect()] == [97, 98, 99]
    assert clean["stays"].filter("row_id <> id").count() == 0
    # replaced
    before = source.load_tables(spark, str(tmp_path), "clean")["plain"].count()
    source.ingest(spark, csv_folder, str(tmp_path))
    assert source.load_tables(spark, str(tmp_path), "clean")["plain"].count() == before


def test_row_ids_follow_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).repartition(6).write.parquet(path)
    df = source.with_row_id(spark, path)
    ids = sorted(r["row_id"] for r in df.collect())
    assert ids == list(range(1000))
    assert sorted(df.collect()) == sorted(source.with_row_id(spark, path).repartition(3).collect())


def test_split_by_hash_is_a_partition(spark):
    df = spark.range(2000).withColumnRenamed("id", "row_id")
    clean, test = source.split(df, 2000, how="hash")
    assert clean.count() + test.count() == 2000 and clean.join(test, "row_id").count() == 0
    assert 30 < test.count() < 95
    with pytest.raises(ValueError):
        source.split(df, 2000, how="other")


def test_publish_and_catalog(spark):
    df = spark.range(3)
    names = source.publish({"alpha": df}, {"alpha": df.limit(1)})
    assert names == ["alpha", "alpha_new_data"]
    found = source.catalog(spark)
    assert ("alpha", "view") in found and ("alpha_new_data", "view") in found
    assert ("alpha", "view") not in source.catalog(spark, tables_only=True)
    assert source.whole_column(df, df.limit(1), "id").count() == 4


def test_bounded_query(spark):
    spark.range(500).createOrReplaceTempView("numbers")
    assert source.bounded_query(spark, " SELECT id FROM numbers ; ", 70).count() == 70
    assert source.run_query(spark, "select id from numbers", 30)["truncated"] and not source.run_query(spark, "select 1 one")["truncated"]
    assert source.run_query(spark, "select count(*) n from numbers")["rows"] == [{"n": 500}]
    assert source.run_query(spark, "DROP VIEW numbers") == {"error": "a statement must be a SELECT"}
    assert source.run_query(spark, "select nothing from numbers")["error"].startswith("not executed")


def test_view_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, l string")
    right = spark.createDataFrame([(1, "yes"), (3, "no")], "key int, r string")
    view = source.joined_view(left, right, [("id", "key")], ["id", "l", "r"], F.col("r") == "yes", 50, ["id"])
    source.create_view(view, "v_test")
    assert [tuple(r) for r in spark.table("v_test").collect()] == [(1, "a", "yes")]


def test_logs(spark, tmp_path):
    folder = str(tmp_path)
    logs.reset(spark, folder, "injections", logs.INJECTION_LOG)
    assert logs.next_id(logs.read(spark, folder, "injections")) == 1
    row = (1, 1, "t", "c", "insert_null", "", "", 5, "", logs.as_params({"rate": 0.5, "none": None}), logs.now())
    logs.append(spark.createDataFrame([row], logs.INJECTION_LOG), folder, "injections")
    log = logs.read(spark, folder, "injections")
    assert logs.next_id(log) == 2 and logs.next_id(log, run_number=9) == 1
    assert log.first()["params"] == {"rate": "0.5"}


def test_stream_of_batches(spark, tmp_path):
    clean = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 50).cast("double").alias("x"),
                                    F.col("id").cast("string").alias("name"))
    profile = read_profiles(profile_dataset({"t": clean}, numeric=False, key="row_id"))["t"]
    incoming, found = str(tmp_path / "in"), str(tmp_path / "found")
    batch = clean.withColumn("row_id", F.col("row_id") + 400).withColumn("name", F.concat("name", F.lit("n")))
    batch.withColumn("x", F.when(F.col("row_id") % 2 == 0, F.col("x"))).write.parquet(incoming)
    stream = spark.readStream.schema(clean.schema).parquet(incoming)
    query = watch(stream, profile, found, str(tmp_path / "checkpoint"), Context(clean={"t": clean}))
    query.awaitTermination(120)
    rows = [(r["column"], r["anomaly"], r["nb_rows_affected"], r["run_number"]) for r in spark.read.parquet(found).collect()]
    assert ("x", "insert_null", 200, 0) in rows


def test_pipeline(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "towns.csv").write_text("town_id,town\n" + "".join(f"{i},t{i}\n" for i in range(300)))
    (folder / "visits.csv").write_text("visit,town,amount,kind\n" + "".join(
        f"{i},{i * 7 % 290},{i % 83 + 0.5},{'abc'[i % 3]}\n" for i in range(2000)))
    scores = run_pipeline(spark, str(folder), str(tmp_path / "out"), runs=2, clusters=False, seed="c")
    assert {r["run_number"] for r in scores.collect()} == {1, 2}
    injections = logs.read(spark, str(tmp_path / "out"), "injections")
    assert injections.count() > 2 and scores.agg(F.sum("matched")).first()[0] > 1
    assert logs.read(spark, str(tmp_path / "out"), "failures").count() == 0
    assert set(source.load_tables(spark, str(tmp_path / "out"), "batch")) == {"towns", "visits"}


def test_batches_meet_stored_keys_without_moving_them(spark):
    parent = spark.range(3_000).selectExpr("id AS row_id", "id * 3 AS code", "concat('p', id) AS name")
    child = spark.range(6_000).selectExpr("id AS row_id", "id AS ref", "(id % 3000) * 3 AS parent_code", "concat('p', id % 2500) AS label")
    clean = {"parent": parent, "child": child}
    profiles = read_profiles(profile_dataset(clean, numeric=False, key="row_id"))
    assert set(profiles["child"].foreign_keys) >= {"parent_code", "label"}
    batch = {"child": spark.range(500).selectExpr(
        "id + 6000 AS row_id", "IF(id % 5 = 0, id, id + 10000) AS ref", "IF(id % 10 = 0, 1, 8991 + id % 4 * 3) AS parent_code",
        "IF(id % 4 = 0, 'nobody', IF(id % 50 = 1, NULL, 'p7')) AS label"),
             "parent": spark.range(1).selectExpr("9000L AS row_id", "9000L AS code", "'new' AS name")}
    store = write_key_store(clean, profiles)
    plain, stored = Context(clean, batch), Context(clean, batch, store)
    wanted = {"orphan_foreign_key", "duplicate_primary_key"}
    found = [sorted(map(tuple, detect(batch["child"], profiles["child"], c, wanted).collect())) for c in (plain, stored)]
    assert found[0] == found[1]
    rows = {(r[1], r[2]): r[5] for r in found[1]}
    assert rows["parent_code", "orphan_foreign_key"] == 50 and rows["label", "orphan_foreign_key"] == 125
    assert rows["ref", "duplicate_primary_key"] == 100
    held = spark.table(store.table)
    assert held.count() == held.distinct().count() and "Bucketed: true" in plan_of(store.marked(held.limit(5), "there"))
    plan = plan_of(detect(batch["child"], profiles["child"], stored, wanted))
    # every exchange lies above the batch: none has the stored keys below it
    for k, line in enumerate(plan.splitlines()):
        if store.table in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            above = [x for x in plan.splitlines()[:k][::-1]]
            for other in above:
                level = len(other) - len(other.lstrip(" :+-"))
                if level < depth:
                    depth = level
                    if "Join" in other:
                        break
                    assert "Exchange" not in other
    store.drop()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_statements_cannot_leave_the_catalog(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    for query in ("SELECT java_method('java.lang.System', 'setProperty', 'probe', '1')", "select reflect ('java.lang.Math', 'abs', -1)",
                  "SELECT `try_reflect`('java.lang.Math', 'abs', -1)", "SELECT * FROM parquet.`/etc`", "SELECT * FROM `text`.`/etc/passwd`"):
        assert source.run_query(spark, query)["error"].startswith("a statement must not"), query
    told = source.run_query(spark, "SELECT 'java_method(x)' AS t, id AS reflect FROM numbers -- reflect(1)\n WHERE id = 1")
    assert told["rows"] == [{"t": "java_method(x)", "reflect": 1}]


def test_file_offsets_are_summed_by_stretches(spark):
    sizes = spark.createDataFrame([(f"f{i:04d}", i % 7) for i in range(500)], "__file string, __n long")
    found = {r["__file"]: r["__before"] for r in source.file_offsets(sizes, 40).collect()}
    before = 0
    for i in range(500):
        assert found[f"f{i:04d}"] == before
        before += i % 7
