"""Catalog, scans, sorting, merging, import, export, jobs and log."""

import datetime as dt
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from slicewright.catalog import Catalog, DatasetError, SkipDataset
from slicewright.functions.hashing import md5_slice
from slicewright.jobs import METHODS, Builder, BuildLog, JobError, JobList, method, timestamp
from slicewright.operators import aggregate, inspect, repartition, sorting, typing
from slicewright.plans.ordinals import deal, number_rows
from slicewright.plans.scan import Scan, row_window
from slicewright.sources import csv, export


def rows(spark, values, schema):
    return deal(number_rows(spark.createDataFrame(values, schema), *schema.split()[:1]), 3).drop("_ord")


@pytest.fixture(scope="module")
def catalog(spark):
    c = Catalog(spark, slices=3)
    before = None
    for k in range(3):
        ds = c.write(f"link{k}", rows(spark, [(10 * k + i, f"v{i}") for i in range(10)], "a int, b string"), previous=before)
        before = ds.id
    return c


def test_chain_and_metadata(catalog):
    chain = catalog.chain("link2")
    assert [d.id for d in chain] == ["link0", "link1", "link2"]
    assert (chain.lines(), chain.lines(0), chain.low("a"), chain.high("a"), chain.column_counts()) == (30, 12, 0, 29, {"a": 3, "b": 3})
    assert [d.id for d in catalog.chain("link2", length=2)] == ["link1", "link2"]
    assert [d.id for d in catalog.chain("link2", stop="link0", reverse=True)] == ["link2", "link1"]
    assert inspect.find(catalog, "link2~2").id == "link0"
    with pytest.raises(DatasetError):
        inspect.find(catalog, "link0~")


def test_catalog_is_read_again(spark, catalog):
    again = Catalog(spark, catalog.root, slices=3)
    assert set(again.known) >= {"link0", "link1", "link2"}
    assert again.read("link1").count() == 10


def test_range_prunes_links_and_filters_rows(catalog):
    scan = Scan(catalog, catalog.chain("link2"), ["a"], range_={"a": (5, 12)})
    assert [d.id for _, d, _ in scan.chosen()] == ["link0", "link1"]
    assert sorted(r["a"] for r in scan.frame().collect()) == list(range(5, 12))


def test_translate_filter_callbacks_rows(catalog):
    def before(ds, part):
        if ds.id == "link1":
            raise SkipDataset

    scan = Scan(catalog, catalog.chain("link2"), ["a", "b"], translators={"b": {"v1": "one"}}, filters={"b": None}, before=before)
    assert sorted((r["a"], r["b"]) for r in scan.frame().collect()) == [(1, "one"), (21, "one")]
    order = [k for s in range(3) for k in range(10) if k % 3 == s]
    assert {r["a"] for r in Scan(catalog, catalog.chain("link0"), ["a"], rows=slice(2, 5)).frame().collect()} == set(order[2:5])
    with pytest.raises(DatasetError):
        row_window(slice(-40, None), 30)
    with pytest.raises(DatasetError):
        Scan(catalog, catalog.chain("link2"), ["missing"]).frame()


def test_merge_parent_and_names(spark, catalog):
    base = catalog.read("link0")
    catalog.write("more", base.select("_slice", "_pos", (F.col("a") * 2).alias("c"), F.lit("x").alias("odd/name `quoted`".replace("`", ""))), parent="link0")
    merged = catalog.merge("both", ["link0", "more"])
    assert set(merged.columns) == {"a", "b", "c", "odd/name quoted"}
    assert all(r["c"] == 2 * r["a"] for r in catalog.read("both").collect())
    with pytest.raises(DatasetError, match="ancestor"):
        catalog.merge("bad", ["link0", "link1"])
    with pytest.raises(DatasetError, match="lines"):
        catalog.write("short", base.limit(3), parent="link0")
    with pytest.raises(DatasetError):
        catalog.filter_columns("none", "link0", discard=["a", "b"])


def test_sort_rules(spark):
    values = [(0, 2.0), (1, None), (2, float("nan")), (3, float("inf")), (4, -1.0), (5, 2.0)]
    df = spark.createDataFrame(values, "i int, v double").withColumns({"_slice": F.lit(0), "_pos": F.col("i").cast("long")})
    order = lambda d: [r["i"] for r in d.orderBy("_slice", "_pos").collect()]
    assert order(sorting.sort_within(df, ["v"])) == [1, 4, 0, 5, 2, 3]
    assert order(sorting.sort_within(df, ["v"], descending=True)) == [2, 3, 0, 5, 4, 1]
    across = sorting.sort_across(df, ["v"], 4).collect()
    assert Counter(r["_slice"] for r in across) == {0: 2, 1: 2, 2: 1, 3: 1}


def test_triggers_and_unroundrobin(spark):
    df = deal(number_rows(spark.createDataFrame([(i, i // 4) for i in range(12)], "i int, g int"), "i"), 3).drop("_ord")
    back = sorting.unroundrobin(df, [4, 4, 4]).orderBy("_slice", "_pos").collect()
    assert [r["i"] for r in back] == list(range(12))
    late = sorting.unroundrobin(df, [2, 5, 5], trigger="g").collect()
    assert {r["_slice"]: {x["g"] for x in late if x["_slice"] == r["_slice"]} for r in late} == {0: {0}, 1: {1}, 2: {2}}


def test_hashpart_colocates_and_discards(spark):
    df = deal(number_rows(spark.createDataFrame([(i, i % 7) for i in range(60)], "i int, k int"), "i"), 4).drop("_ord")
    out = repartition.hashpart(df, "k", 4)
    assert out.select("k", "_slice").distinct().count() == 7
    assert repartition.discard_wrong(out, "k", 4).count() == 60
    assert {r["_slice"] for r in out.where("k = 0").collect()} == {0}
    assert repartition.exact_slices(out, 4).select(F.spark_partition_id().alias("p"), "_slice").where("p <> _slice").count() == 0
    assert df.where(md5_slice(F.lit(None).cast("int"), 4) != 0).count() == 0


def test_merge_auto():
    assert aggregate.merge_auto([1, 2]) == 3
    assert aggregate.merge_auto([[1], [2]]) == [1, 2]
    assert aggregate.merge_auto([{1}, {2}]) == {1, 2}
    assert aggregate.merge_auto([{"a": Counter(x=1)}, {"a": Counter(x=2), "b": Counter(y=1)}]) == {"a": Counter(x=3), "b": Counter(y=1)}
    assert aggregate.merge_auto([{"a": 1}, {"a": 2}]) == {"a": 2}
    assert aggregate.merge_auto([(1, [1]), (2, [2])]) == (3, [1, 2])
    with pytest.raises(ValueError, match="empty"):
        aggregate.merge_auto([{"a": {}}, {"a": {"x": 1}}])


def test_typing_policies(spark):
    df = spark.createDataFrame([(0, "1", "a"), (1, "x", "b"), (2, None, "c")], "p long, n string, t string").withColumns({"_slice": F.lit(0), "_pos": F.col("p")}).drop("p")
    spec = typing.TypeSpec({"n": "int32_10"}, rename={"t": None}, filter_bad=True)
    assert [r["n"] for r in typing.dataset_type(df, spec).orderBy("_pos").collect()] == [1, 0]
    with pytest.raises(Exception, match="bad value"):
        typing.dataset_type(df, typing.TypeSpec({"n": "int32_10"})).collect()
    assert typing.bad_report(df, typing.TypeSpec({"n": "int32_10"})).first()["first_lines"] == [1]
    with pytest.raises(ValueError, match="one name"):
        typing.TypeSpec({}, rename={"n": "z", "t": "z"}).out_names(["n", "t"])


def put(tmp_path, data):
    path = tmp_path / "in.csv"
    path.write_bytes(data)
    return str(path)


CASES = [
    (b"ix,0,1\r\n1,a,a\n2,b,b\r\n3,c,c", {}, {b"1", b"2", b"3"}, [], []),
    (b"ix,0,1\n1,a,a\n2,b,c,d\n", {"allow_bad": True}, {b"1"}, [3], []),
    (b"# x\nix,0,1\n1,a,#\n#3,c,c\n", {"comment": "#"}, {b"1"}, [], [1, 4]),
    (b"junk\njunk\nix,0,1\n1,a,a\n2,b\n", {"skip_lines": 2, "allow_bad": True}, {b"1"}, [5], [1, 2]),
    (b"ix,0,1,,,,\n2,b,b,,\n", {"allow_extra_empty": True}, {b"2"}, [], []),
    (b"\nix,0,1\n\n1,a,a\n \n", {"skip_empty_lines": True, "allow_bad": True}, {b"1"}, [5], [1, 3]),
    (b"ix|0|1;1|a|a;", {"separator": "|", "newline": ";"}, {b"1"}, [], []),
    (b"ix,0,1\n", {}, set(), [], []),
]


@pytest.mark.parametrize(("data", "options", "good", "bad", "skipped"), CASES)
def test_csv(spark, tmp_path, data, options, good, bad, skipped):
    got = csv.read_csv(spark, put(tmp_path, data), csv.CsvOptions(**options), 3)
    assert {bytes(r["ix"]) for r in got.good.collect()} == good
    assert sorted(r["lineno"] for r in got.bad.collect()) == bad
    assert sorted(r["lineno"] for r in got.skipped.collect()) == skipped


def test_csv_failures(spark, tmp_path):
    with pytest.raises(csv.BadLine):
        csv.read_csv(spark, put(tmp_path, b"a,b\n1\n"))
    with pytest.raises(ValueError, match="same"):
        csv.read_csv(spark, put(tmp_path, b"a,a\n1,2\n"))


def test_export_forms(spark, tmp_path):
    df = spark.createDataFrame([(0, 1e7, None, True), (1, 0.1, 'a"b,', False)], "p long, f double, s string, b boolean").withColumns({"_slice": F.lit(0), "_pos": F.col("p")}).drop("p")
    lines = [r["line"] for r in export.lines(df, export.ExportOptions(quote_fields='"', lazy_quotes=True, none_as={"s": "nil"})).orderBy("_pos").collect()]
    assert lines == ["True,10000000.0,nil", 'False,0.1,"a""b,"']
    export.write_csv(df, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()][0] == "b,f,s"


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 as b", "id * 3 as c").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).select("id", "b").where("b >= 10")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(b), GreaterThanOrEqual(b,10)]" in plan
    assert "c:bigint" not in plan


@method(options={"n": 1}, datasets=("source",), jobs=("previous",))
def double(options, builder):
    return options["n"] * 2


@method(options={"n": 1})
def outer(options, builder):
    return builder.build("double", n=options["n"]).result


def test_jobs():
    b = Builder()
    one = b.build("double", n=3)
    assert one.result == 6
    assert b.build("double", n=3) is one
    assert b.build("double", n=3, force=True) is not one
    two = b.build("double", n=4, previous=one)
    assert [j.id for j in b.chain(two)] == [one.id, two.id]
    assert {k for d in b.why_build("double", n=5).values() for k in d} <= {"n", "previous"}
    assert b.made.find("double")[-1] is two
    with pytest.raises(JobError, match="unknown"):
        b.build("double", m=1)


def test_jobs_outlive_the_session(tmp_path):
    path = str(tmp_path / "jobs")
    first = Builder(path)
    one = first.build("double", n=3)
    two = first.build("double", n=4, previous=one)
    unkept = first.build("double", n=(3,))  # JSON has no tuples
    late = first.build("double", n=7, previous=unkept)
    assert [j.kept for j in (one, two, unkept, late)] == [True, True, False, False]
    again = Builder(path)
    found = again.build("double", n=3)
    assert (found.id, found.result, len(again.jobs)) == (one.id, 6, 2)
    assert again.build("double", n=4, previous=found).id == two.id
    assert [j.id for j in again.chain(again.jobs[1])] == [one.id, two.id]
    new = again.build("double", n=5)
    assert new.id not in (one.id, two.id) and Builder(path).build("double", n=5).id == new.id


def test_a_changed_method_makes_its_jobs_and_those_above_build_again(tmp_path, monkeypatch):
    path = str(tmp_path / "jobs")
    first = Builder(path)
    outer = first.build("outer", n=2)
    assert len({j.id for j in first.jobs}) == 2
    assert Builder(path).build("outer", n=2).id == outer.id
    monkeypatch.setitem(METHODS, "double", replace(METHODS["double"], run=lambda options: options["n"] * 3))
    again = Builder(path).build("outer", n=2)
    assert again.id != outer.id and again.result == 6


def test_log(tmp_path):
    path = str(tmp_path / "log")
    log = BuildLog(path)
    for at in ("2016-10-01 03", "2016-10-01 20", 7):
        log.begin("a/b", at)
        log.finish(JobList())
    log.begin("a/c", 1)
    assert log.get("a/b", "<=2016-10-01").timestamp == "2016-10-01 20"
    log.finish(JobList())
    assert sorted(["2016-10-01", 5, "2016-10-01+1", 100], key=timestamp) == [5, 100, "2016-10-01", "2016-10-01+1"]
    again = BuildLog(path)
    assert again.peek("a/b", "first").timestamp == 7
    assert again.since("a/b", 7) == ["2016-10-01 03", "2016-10-01 20"]
    again.truncate("a/b", "2016-10-01 20")
    assert [g.key for g in again.ghosts] == ["a/b", "a/c"]
    assert BuildLog(path).keys() == ["a/b"]


def test_stream_appends_links(spark, tmp_path):
    from slicewright.streaming.chains import append_links

    folder, schema = str(tmp_path / "in"), spark.range(1).schema
    c = Catalog(spark, slices=3)
    for k in range(2):
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(folder)
        append_links(spark, c, folder, schema, "stream", ["id"], str(tmp_path / "checkpoint"))
    assert c.chain(list(c.known)[-1]).lines() == 20


def test_dates_in_ranges_survive_a_new_session_of_the_catalog(spark):
    c = Catalog(spark, slices=3)
    c.write("d", rows(spark, [(dt.date(2020, 1, k), k) for k in range(1, 9)], "d date, k int"))
    again = Catalog(spark, c.root, slices=3)
    assert Scan(again, again.chain("d"), ["k"], range_={"d": (dt.date(2020, 1, 3), dt.date(2020, 1, 5))}).frame().count() == 2


def test_a_catalog_that_is_read_again_keeps_types_and_order(spark):
    from decimal import Decimal

    c = Catalog(spark, slices=3)
    for k in range(12):
        c.write(f"j/{k}", rows(spark, [(Decimal(9 + 91 * k), dt.datetime(2020, 1, 1 + k), None)], "n decimal(20,0), t timestamp, e int"))
    again = Catalog(spark, c.root, slices=3)
    assert list(again.known) == list(c.known)
    assert again.known == c.known
    assert again.of_job("j") == [str(k) for k in range(12)]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    from slicewright.streaming.chains import append_links

    folder, schema = str(tmp_path / "in"), spark.range(1).schema
    root = Catalog(spark, slices=3).root
    for k in range(4):
        c = Catalog(spark, root, slices=3)
        if not k:
            c.write("stream-other", rows(spark, [(1,)], "id long"))
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(folder)
        append_links(spark, c, folder, schema, "stream", ["id"], str(tmp_path / "checkpoint"))
    assert [d.id for d in c.chain("stream-3")] == [f"stream-{k}" for k in range(4)]
    assert c.chain("stream-3").lines() == 40


def test_dataset_without_rows(spark):
    c = Catalog(spark, slices=3)
    c.write("none", rows(spark, [], "a int, b string"))
    again = Catalog(spark, c.root, slices=3)
    assert again.get("none").lines == [0, 0, 0]
    out = again.read("none")
    assert out.columns == ["_slice", "_pos", "a", "b"] and dict(out.dtypes)["a"] == "int" and out.count() == 0


def test_chains_are_hashed_and_sorted_from_where_the_last_one_ended(spark, catalog):
    repartition.hashpart_chain(catalog, "h1", "link1", "b")
    late = repartition.hashpart_chain(catalog, "h2", "link2", "b", previous="h1")
    assert (sum(late.lines), late.hashlabel, late.previous, late.source) == (10, "b", "h1", "link2")
    assert all(r["_slice"] == r["want"] for r in catalog.read(late).withColumn("want", md5_slice(F.col("b"), 3)).collect())
    parts = repartition.hashpart_chain(catalog, "h3", "link2", "a", as_chain=True)
    assert [d.id for d in catalog.chain(parts.id)] == ["h3/0", "h3/1", "h3"] and catalog.chain(parts.id).lines() == 30
    done = sorting.sort_chain(catalog, "s", "link2", ["a"], descending=True)
    for k in range(3):
        got = [r["a"] for r in catalog.read(done).where(F.col("_slice") == k).orderBy("_pos").collect()]
        assert got == sorted(got, reverse=True) and len(got) == done.lines[k]
    assert sorting.sort_chain(catalog, "s2", "h2", ["a"]).hashlabel == "b"


def test_chain_export_goes_on_and_imports_as_a_chain(spark, catalog, tmp_path):
    done = export.export_chain(catalog, "link1", str(tmp_path / "first"))
    export.export_chain(catalog, "link2", str(tmp_path / "then"), exported=done.id)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "then")).collect()) == sorted(["a,b", *[f"{20 + i},v{i}" for i in range(10)]])
    with pytest.raises(DatasetError):
        export.export_chain(catalog, "link2", str(tmp_path / "none"), exported="link2")
    export.export_chain(catalog, "link2", str(tmp_path / "sliced"), sliced=True)
    assert sum(r[0] == "a,b" for r in spark.read.text(str(tmp_path / "sliced")).collect()) == 3
    new = Catalog(spark, slices=3)
    csv.import_link(new, "one", str(tmp_path / "first"))
    csv.import_link(new, "two", str(tmp_path / "then"), previous="one")
    assert (new.chain("two").lines(), new.chain("two/bad").lines(), new.get("two/skipped").previous) == (30, 0, "one/skipped")
