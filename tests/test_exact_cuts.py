"""Exact cuts without a global sort on one machine: first n rows, the stratified split, out-of-fold rates,
encoding by file, the checks of one batch, and scoring with a stored model."""

import collections
import math
import os

import pytest
from pyspark.sql import functions as F

from skyledger.schemas import TABLES, empty_table


# ---------------------------------------------------------------- first n rows

@pytest.mark.parametrize("n", [0, 1, 499, 500, 3_000, 5_000, 9_999])
def test_first_rows_are_the_first_in_order(spark, n):
    from skyledger.operators.ids import first_rows
    df = (spark.range(5_000).select((F.hash("id") % 40).alias("a"), F.when(F.col("id") % 7 != 0, F.col("id") % 50).alias("b"), "id")
          .repartition(11))
    order = ["a", "b", "id"]
    want = sorted(df.collect(), key=lambda r: (r.a, r.b is not None, r.b or 0, r.id))[:n]
    got = first_rows(df, n, order)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want)
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()


def test_first_rows_of_nothing_and_by_a_struct(spark):
    from skyledger.operators.ids import first_rows
    df = spark.range(30).select(F.struct((F.col("id") % 3).alias("number"), F.col("id").cast("string").alias("path")).alias("page"), F.col("id").alias("pos"))
    want = sorted(df.collect(), key=lambda r: (r.page.number, r.page.path, r.pos))[:12]
    assert {r.pos for r in first_rows(df, 12, ["page", "pos"]).collect()} == {r.pos for r in want}
    assert first_rows(df.limit(0), 5, ["page", "pos"]).collect() == []


# ---------------------------------------------------------------- exact stratified split

def _expected_test_counts(counts):
    """Whole shares of the train split first, then by largest remainder (ties: smaller label)."""
    total = sum(counts.values())
    train = total - math.ceil(total * 0.2)
    take = {c: n * train // total for c, n in counts.items()}
    left = train - sum(take.values())
    for c in sorted(counts, key=lambda c: (-(counts[c] * train % total), c is not None, c))[:left]:
        take[c] += 1
    return {c: counts[c] - take[c] for c in counts if counts[c] > take[c]}


@pytest.mark.parametrize("weights", [{0: 70, 1: 30}, {0: 1, 1: 6, 2: 3}, {0: 997, 1: 3, 2: 50, None: 13}, {1: 4}])
def test_each_class_gives_exactly_its_share(spark, weights):
    from skyledger.ml.training import stratified_split
    rows = [(i, c) for i, c in enumerate(c for c, n in weights.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "k long, y int")
    out = stratified_split(df, "k", "y").collect()
    assert sorted((r.k, r.y) for r in out) == sorted(rows, key=lambda r: r[0])
    assert collections.Counter(r.y for r in out if r.split == "test") == _expected_test_counts(weights)
    again = stratified_split(df.repartition(5), "k", "y").collect()
    assert {r.k: r.split for r in again} == {r.k: r.split for r in out}


def test_rows_that_share_a_draw_are_told_apart_by_key(spark, monkeypatch):
    from skyledger.ml import training
    monkeypatch.setattr(training, "split_hash", lambda key: F.lit(70_000).cast("bigint") + F.col(key) * 0 if isinstance(key, str) else None)
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("y"))
    test = {r.k for r in training.stratified_split(df, "k", "y").where("split = 'test'").collect()}
    assert test == set(range(10))
    assert training.stratified_split(df.limit(0), "k", "y").collect() == []


# ---------------------------------------------------------------- out-of-fold rates

def test_a_label_never_feeds_its_own_rate(spark):
    from skyledger.operators.features import attach_out_of_fold_rates, fold_column
    groups = {"a_rate": ["a"], "ab_rate": ["a", "b"]}
    data = [(i, ["x", "y", None][i % 3], "pq"[i % 2], int(i * 7919 % 10 < 4)) for i in range(200)] + [(900, "once", "p", 1)]

    def rates(rows):
        df = spark.createDataFrame(rows, "k long, a string, b string, target_delayed int").withColumn("fold", fold_column("k"))
        return {r.k: r for r in attach_out_of_fold_rates(df, "fold", groups).collect()}

    got = rates(data)
    fold = {k: r.fold for k, r in got.items()}
    assert len(got) == len(data) and set(fold.values()) == set(range(5))
    for k, a, b, _ in data:
        others = [r for r in data if fold[r[0]] != fold[k]]
        mean = sum(r[3] for r in others) / len(others)
        for name, same in (("a_rate", [r[3] for r in others if r[1] == a and a]), ("ab_rate", [r[3] for r in others if r[1:3] == (a, b) and a])):
            assert got[k][name] == pytest.approx(sum(same) / len(same) if same else mean)
    for k in (0, 55, 900):
        flipped = rates([(*r[:3], 1 - r[3]) if r[0] == k else r for r in data])
        assert flipped[k][:4] == got[k][:4] and (flipped[k].a_rate, flipped[k].ab_rate) == (got[k].a_rate, got[k].ab_rate)
        assert any(flipped[j].a_rate != got[j].a_rate for j in got if fold[j] != fold[k])
    one = rates(data[:1])
    assert (one[0].a_rate, one[0].ab_rate) == (0.0, 0.0)


# ---------------------------------------------------------------- encoding by file

def test_each_file_keeps_its_own_encoding(spark, tmp_dir):
    from skyledger.sources.files import files_by_encoding, read_csv_any_encoding
    texts = {"a one.csv": ("CITY,N\nMalmö,1\n", "utf-8"), "b.csv": ("CITY,N\nOrléans,2\n", "latin-1"),
             "c.csv": ("CITY,N\nbroken � mark,3\n", "utf-8"), "d.csv": ("CITY,N\nZürich,4\n", "utf-8-sig"),
             "e.csv": ("CITY,N\nplain,5\n", "ascii")}
    for name, (text, encoding) in texts.items():
        with open(os.path.join(tmp_dir, name), "w", encoding=encoding) as f:
            f.write(text)
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("city", T.StringType()), T.StructField("n", T.IntegerType())])
    good, other = files_by_encoding(spark, tmp_dir)
    assert [f.split("/")[-1] for f in good] == ["a one.csv", "c.csv", "d.csv", "e.csv"] and [f.split("/")[-1] for f in other] == ["b.csv"]
    got = {r.n: r.city for r in read_csv_any_encoding(spark, tmp_dir, schema).collect()}
    assert got == {1: "Malmö", 2: "Orléans", 3: "broken � mark", 4: "Zürich", 5: "plain"}
    assert read_csv_any_encoding(spark, f"{tmp_dir}/d.csv").columns == ["city", "n"]


# ---------------------------------------------------------------- an old version with fewer columns

def test_a_table_version_with_fewer_columns_reads_as_nulls(spark, tmp_dir):
    from skyledger.schemas import conform
    path = f"{tmp_dir}/dim_airport"
    spark.createDataFrame([(1, "AAA", "A")], "airport_id int, airport_code string, airport_name string").write.parquet(path)
    conform(spark.createDataFrame([(2, "BBB", 1.5)], "airport_id int, airport_code string, latitude double"),
            TABLES["dim_airport"]).write.mode("append").parquet(path)
    rows = {r.airport_id: r for r in spark.read.schema(TABLES["dim_airport"]).parquet(path).collect()}
    assert (rows[1].airport_name, rows[1].latitude, rows[1].elevation) == ("A", None, None)
    assert (rows[2].airport_name, rows[2].latitude) == (None, 1.5)


# ---------------------------------------------------------------- checks of one batch

def test_batch_checks_equal_the_difference_of_the_full_reports(spark, tmp_dir):
    from skyledger.operators.merge import untouched_rows, upsert_fact
    from skyledger.operators.quality import batch_constraint_change, constraint_report
    from skyledger.plans.warehouse import run_timestamp
    from tests.test_warehouse_commits import _rows
    tables = {n: empty_table(spark, n) for n in TABLES}
    tables["dim_flight"] = spark.range(60).select(F.col("id").cast("int").alias("flight_id"), F.col("id").cast("string").alias("flight_number"))
    first = upsert_fact(tables["fact_flightperformance"], _rows(spark, range(80)), ["o"], run_timestamp(), target_is_empty=True).affected
    # files of their own months: broken rows stand both in touched and in untouched ones
    bad = first.where("flight_id in (3, 70)")
    path = f"{tmp_dir}/fact"
    for i, part in enumerate((first.where("flight_id < 40"), first.where("flight_id >= 40"), bad)):
        part.withColumn("flight_month", F.lit(202401)).write.mode("append").parquet(path)
    tables["fact_flightperformance"] = spark.read.schema(TABLES["fact_flightperformance"]).parquet(path)
    merge = upsert_fact(tables["fact_flightperformance"], _rows(spark, [3, 5, 65, 200], delay=20), ["o"], run_timestamp())
    after = dict(tables)
    after["fact_flightperformance"] = untouched_rows(tables["fact_flightperformance"], merge).unionByName(merge.affected)
    after["dim_flight"] = tables["dim_flight"].unionByName(spark.createDataFrame([(500, "7"), (501, None)], "flight_id int, flight_number string"))

    def report(t):
        return {(r.table_name, r.check_name): r.violations for r in constraint_report(t).collect()}
    before_report, after_report = report(tables), report(after)
    got = {(r.table_name, r.check_name): r.change for r in batch_constraint_change(tables, after, merge, ["dim_flight"]).collect()}
    assert len(got) == 1 + 10 + 3
    for check in after_report:
        assert got.get(check, 0) == after_report[check] - before_report[check], check
    assert got[("fact_flightperformance", "orphan flight_id")] == 1 and got[("dim_flight", "duplicate flight_number")] == 1
    assert got[("dim_flight", "null flight_number")] == 1 and before_report[("fact_flightperformance", "duplicate natural key")] == 2


# ---------------------------------------------------------------- a stored model

def test_a_stored_model_scores_batches_and_streams_and_refuses_other_features(spark, tmp_dir):
    from skyledger.ml import training as M
    numeric, categorical = ["day", "hour"], ["airline_code"]
    rows = [(i, f"F{i}", float(i % 28), float(i % 24), "AB"[i % 2], i % 2) for i in range(120)]
    fields = "flight_performance_id long, flight_number string, day double, hour double, airline_code string, target_delayed int"
    df = M.with_class_weights(spark.createDataFrame(rows, fields))
    prep = M.Pipeline(stages=M.preprocessing_stages(numeric, categorical)).fit(df)
    tree = M.classifiers(1)["Decision Tree"].fit(prep.transform(df))
    path = f"{tmp_dir}/model"
    with pytest.raises(FileNotFoundError):
        M.load_stored_model(spark, path)
    M.store_model(M.PipelineModel(stages=[*prep.stages, tree]), path, "v1", numeric + categorical)
    model = M.load_stored_model(spark, path)
    assert (model.features, model.data_version) == (numeric + categorical, "v1")
    inputs = df.select("flight_performance_id", "flight_number", "day", "hour", "airline_code")
    scored = {r.flight_performance_id: r for r in model.score(inputs).collect()}
    assert {k: r.prediction for k, r in scored.items()} == {r[0]: r[5] for r in rows}
    assert all(0.5 <= r.probability <= 1 and r.data_version == "v1" for r in scored.values())
    assert {r.prediction_label for r in scored.values()} == {"Delayed", "On Time"}
    for other in (inputs.drop("hour"), inputs.withColumn("minute", F.lit(0.0)), inputs.select("flight_number", "hour", "day", "airline_code")):
        with pytest.raises(ValueError, match="other features"):
            model.score(other)
    inputs.write.parquet(f"{tmp_dir}/in")
    query = (model.score(spark.readStream.schema(inputs.schema).parquet(f"{tmp_dir}/in")).writeStream.format("parquet")
             .option("path", f"{tmp_dir}/out").option("checkpointLocation", f"{tmp_dir}/ckpt").trigger(availableNow=True).start())
    query.awaitTermination()
    streamed = {r.flight_performance_id: r.prediction for r in spark.read.parquet(f"{tmp_dir}/out").collect()}
    assert streamed == {k: r.prediction for k, r in scored.items()}
