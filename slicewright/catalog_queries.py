"""Queries over the driver's tables, one per operator, each beside SQL that gives the same rows.

Tables are dealt round robin to ``N`` slices in the order of their keys, so ``_slice`` is ord % N and ``_pos`` is ord // N on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewright.catalog import Catalog, Dataset, SkipDataset, SkipSlice, largest, least
from slicewright.functions import converters
from slicewright.functions.hashing import md5_slice, sip_slice
from slicewright.operators import aggregate, extensions, inspect, repartition, sorting, typing
from slicewright.plans.ordinals import deal, number_rows
from slicewright.plans.scan import Scan
from slicewright.session import shared_dir, table
from slicewright.sources import csv, export

N = 4
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]


def query(sql: str | None = None):
    def wrap(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLE[f.__name__] = sql
        return f

    return wrap


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def sliced(spark: SparkSession, sf_dir: str, name: str, *key: str, columns: list[str] | None = None) -> DataFrame:
    """A table, or the columns named of it, with ``_slice``, ``_pos`` and ``_ord``."""
    rows = table(spark, sf_dir, name)
    return deal(number_rows(rows.select(*columns) if columns else rows, *key), N)


def ord_sql(name: str, key: str) -> str:
    return f"(select *, row_number() over (order by {key}) - 1 as ord from {name})"


def years_of(orders: DataFrame, day: str) -> range:
    """The years from the first to the last order."""
    low, high = orders.agg(F.min(F.year(day)), F.max(F.year(day))).first()
    return range(0) if low is None else range(low, high + 1)


def order_chain(spark: SparkSession, sf_dir: str) -> tuple[Catalog, list[Dataset]]:
    """Orders as a chain of links by year, oldest first, each dealt by order key; those without a date are in the first."""
    catalog = Catalog(spark, slices=N)
    orders = table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    links, before = [], None
    for year in (years := years_of(orders, "day")):
        mine = F.coalesce(F.year("day"), F.lit(years[0])) == year
        rows = deal(number_rows(orders.where(mine), "o_orderkey"), N).drop("_ord", "o_orderdate")
        ds = catalog.write(f"orders-{year}", rows, previous=before)
        links.append(ds)
        before = ds.id
    return catalog, links


# ---- scans ----


@query("select o_orderkey, (ord // 4)::bigint as pos from " + ord_sql("orders", "o_orderkey") + " where ord % 4 = 2")
def scan_slice(spark, sf_dir):
    return sliced(spark, sf_dir, "orders", "o_orderkey").where("_slice = 2").select("o_orderkey", F.col("_pos").alias("pos"))


@query("select n_name, row_number() over (order by ord % 4, ord // 4) as rank from " + ord_sql("nation", "n_nationkey"))
def scan_all_ordered(spark, sf_dir):
    rows = sliced(spark, sf_dir, "nation", "n_nationkey").drop("_ord")
    return number_rows(rows, "_slice", "_pos", name="r").select("n_name", (F.col("r") + 1).alias("rank"))


@query("select n_name, row_number() over (order by ord // 4, ord % 4) as rank from " + ord_sql("nation", "n_nationkey"))
def scan_roundrobin(spark, sf_dir):
    catalog = Catalog(spark, slices=N)
    ds = catalog.write("nation", sliced(spark, sf_dir, "nation", "n_nationkey").drop("_ord"))
    scan = Scan(catalog, [ds], slice_="roundrobin")
    return number_rows(scan.frame(), *scan.order(), name="r").select("n_name", (F.col("r") + 1).alias("rank"))


_LINK = "coalesce(year(o_orderdate) - (select min(year(o_orderdate)) from orders), 0)::int"


@query(f"select o_orderkey, {_LINK} as link from orders")
def scan_chain(spark, sf_dir):
    catalog, links = order_chain(spark, sf_dir)
    return Scan(catalog, catalog.chain(links[-1].id), ["o_orderkey"]).frame().select("o_orderkey", F.col("_chain_ix").alias("link"))


@query(f"select o_orderkey, ({_LINK} - 5)::int as link from orders where {_LINK} >= 5")
def chain_partial(spark, sf_dir):
    catalog, links = order_chain(spark, sf_dir)
    return Scan(catalog, catalog.chain(links[-1].id, length=2), ["o_orderkey"]).frame().select("o_orderkey", F.col("_chain_ix").alias("link"))


@query(f"select o_orderkey, ({_LINK} - 3)::int as link from orders where {_LINK} > 2")
def chain_stop(spark, sf_dir):
    catalog, links = order_chain(spark, sf_dir)
    return Scan(catalog, catalog.chain(links[-1].id, stop=links[2].id), ["o_orderkey"]).frame().select("o_orderkey", F.col("_chain_ix").alias("link"))


@query(f"select o_orderkey, (6 - {_LINK})::int as link from orders")
def chain_reverse(spark, sf_dir):
    catalog, links = order_chain(spark, sf_dir)
    return Scan(catalog, catalog.chain(links[-1].id, reverse=True), ["o_orderkey"]).frame().select("o_orderkey", F.col("_chain_ix").alias("link"))


@query(f"select o_orderkey, ({_LINK} % 2)::int as link from orders where {_LINK} in (1, 4)")
def rechain(spark, sf_dir):
    catalog, links = order_chain(spark, sf_dir)
    catalog.link("again", links[4].id, columns=["o_orderkey"], previous=links[1].id)
    rows = Scan(catalog, catalog.chain("again", length=2), ["o_orderkey"]).frame()
    return rows.select("o_orderkey", F.when(F.col("_chain_ix") == 0, 1).otherwise(0).alias("link"))


# ---- projection, translation, filters ----


@query("select c_name, c_acctbal from customer")
def project_columns(spark, sf_dir):
    return _scan(spark, sf_dir, "customer", "c_custkey", columns=["c_name", "c_acctbal"]).select("c_name", "c_acctbal")


@query("select c_custkey, c_mktsegment from customer")
def filter_columns_keep(spark, sf_dir):
    catalog = Catalog(spark, slices=N)
    catalog.write("c", sliced(spark, sf_dir, "customer", "c_custkey").drop("_ord"))
    return catalog.read(catalog.filter_columns("kept", "c", keep=["c_custkey", "c_mktsegment"])).drop("_slice", "_pos")


@query("select c_acctbal, c_custkey, c_nationkey from customer")
def filter_columns_discard(spark, sf_dir):
    catalog = Catalog(spark, slices=N)
    catalog.write("c", sliced(spark, sf_dir, "customer", "c_custkey").drop("_ord"))
    return catalog.read(catalog.filter_columns("kept", "c", discard=["c_name", "c_mktsegment", "no such"])).drop("_slice", "_pos")


def _scan(spark, sf_dir, name, key, **how) -> DataFrame:
    catalog = Catalog(spark, slices=N)
    ds = catalog.write(name, sliced(spark, sf_dir, name, key).drop("_ord"))
    scan = Scan(catalog, [ds], **how)
    return scan.frame()


@query("select n_name, case n_regionkey when 0 then 'zero' when 1 then 'one' end as n_regionkey from nation")
def translate_dict(spark, sf_dir):
    return _scan(spark, sf_dir, "nation", "n_nationkey", columns=["n_name", "n_regionkey"], translators={"n_regionkey": {0: "zero", 1: "one"}}).select("n_name", "n_regionkey")


@query("select lower(n_name) as n_name, n_regionkey * 10 as n_regionkey from nation")
def translate_fn(spark, sf_dir):
    return _scan(spark, sf_dir, "nation", "n_nationkey", columns=["n_name", "n_regionkey"], translators={"n_name": F.lower, "n_regionkey": lambda c: c * 10}).select("n_name", "n_regionkey")


@query("select n_name || '/' || n_regionkey as label from nation")
def translate_rows(spark, sf_dir):
    label = lambda df: df.withColumn("label", F.concat_ws("/", "n_name", "n_regionkey")).drop("n_name", "n_regionkey")
    return _scan(spark, sf_dir, "nation", "n_nationkey", columns=["n_name", "n_regionkey"], row_translator=label).select("label")


@query("select c_custkey from customer where c_acctbal > 5000 and c_nationkey <> 0")
def filter_column(spark, sf_dir):
    return _scan(spark, sf_dir, "customer", "c_custkey", columns=["c_custkey", "c_acctbal", "c_nationkey"], filters={"c_acctbal": lambda c: c > 5000, "c_nationkey": None}).select("c_custkey")


@query("select l_orderkey, l_linenumber from lineitem where l_quantity > l_linenumber * 10")
def filter_tuple(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > F.col("l_linenumber") * 10).select("l_orderkey", "l_linenumber")


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def filter_membership(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    orders = table(spark, sf_dir, "orders")
    return orders.join(chosen, orders["o_custkey"] == chosen["c_custkey"], "left_semi").select("o_orderkey")


_RANGE = {"day": ("1997-03-01", "1998-02-01")}


@query("select o_orderkey from orders where o_orderdate >= '1997-03-01' and o_orderdate < '1998-02-01'")
def range_filter(spark, sf_dir):
    import datetime as dt

    catalog, links = order_chain(spark, sf_dir)
    days = {"day": (dt.date(1997, 3, 1), dt.date(1998, 2, 1))}
    return Scan(catalog, links, ["o_orderkey"], range_=days).frame().select("o_orderkey")


@query("select o_orderkey from orders where o_orderdate >= '2000-05-05'")
def range_open_ended(spark, sf_dir):
    import datetime as dt

    catalog, links = order_chain(spark, sf_dir)
    return Scan(catalog, links, ["o_orderkey"], range_={"day": (dt.date(2000, 5, 5), None)}).frame().select("o_orderkey")


@query("select 'orders-' || y as link from (values (1997), (1998)) t(y)")
def range_pruned_links(spark, sf_dir):
    import datetime as dt

    catalog, links = order_chain(spark, sf_dir)
    left = Scan(catalog, links, range_={"day": (dt.date(1997, 3, 1), dt.date(1998, 2, 1))}).chosen()
    return spark.createDataFrame([(ds.id,) for _, ds, _ in left], "link string")


@query("select o_orderkey from orders where year(o_orderdate) in (1997, 1998)")
def sloppy_range(spark, sf_dir):
    import datetime as dt

    catalog, links = order_chain(spark, sf_dir)
    return Scan(catalog, links, ["o_orderkey"], range_={"day": (dt.date(1997, 3, 1), dt.date(1998, 2, 1))}, sloppy_range=True).frame().select("o_orderkey")


_SLICED = "(select *, row_number() over (order by ord % 4, ord // 4) - 1 as r, count(*) over () as n from " + ord_sql("customer", "c_custkey") + ")"


@query(f"select c_custkey from {_SLICED} where r >= 10 and r < 100")
def slice_rows(spark, sf_dir):
    return _scan(spark, sf_dir, "customer", "c_custkey", columns=["c_custkey"], rows=slice(10, 100)).select("c_custkey")


@query(f"select c_custkey from {_SLICED} where r >= n - 7")
def slice_negative(spark, sf_dir):
    return _scan(spark, sf_dir, "customer", "c_custkey", columns=["c_custkey"], rows=-7).select("c_custkey")


@query(f"select c_custkey from {_SLICED} where r >= 5 and (r - 5) % 3 = 0")
def slice_step(spark, sf_dir):
    return _scan(spark, sf_dir, "customer", "c_custkey", columns=["c_custkey"], rows=slice(5, None, 3)).select("c_custkey")


@query("select o_orderkey from orders where year(o_orderdate) not in (1996, 1999)")
def callback_skip_dataset(spark, sf_dir):
    catalog, links = order_chain(spark, sf_dir)

    def before(ds, part):
        if part is None and ds.id in ("orders-1996", "orders-1999"):
            raise SkipDataset

    return Scan(catalog, links, ["o_orderkey"], before=before).frame().select("o_orderkey")


@query("select o_orderkey from (select *, row_number() over (partition by year(o_orderdate) order by o_orderkey) - 1 as ord from orders) where not (ord % 4 = 1 and year(o_orderdate) = 1997)")
def callback_skip_slice(spark, sf_dir):
    catalog, links = order_chain(spark, sf_dir)

    def before(ds, part):
        if ds.id == "orders-1997" and part == 1:
            raise SkipSlice

    return Scan(catalog, links, ["o_orderkey"], before=before).frame().select("o_orderkey")


# ---- typing ----


def _typed(df: DataFrame, key: str, text: Column, kind: str, cast: str | None = None, **how) -> DataFrame:
    t = converters.converter(kind, **how)(text)
    value = t["value"].cast(cast) if cast else t["value"]
    return df.select(key, t["ok"].alias("ok"), value.alias("value"))


_JUNK = "case when o_orderkey % 7 = 0 then 'x' when o_orderkey % 11 = 0 then '' when o_orderkey % 5 = 0 then ' ' || o_orderkey || ' ' else cast(o_orderkey as varchar) end"
_JUNK_SPARK = _JUNK.replace("varchar", "string")


def _junk(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("t", F.expr(_JUNK_SPARK))


@query(f"select o_orderkey, v is not null as ok, v as value from (select o_orderkey, case when t = '' then 0 when trim(t) ~ '^[0-9]+$' then trim(t)::int end as v from (select o_orderkey, {_JUNK} as t from orders))")
def type_int10(spark, sf_dir):
    return _typed(_junk(spark, sf_dir), "o_orderkey", F.col("t"), "int32_10")


@query("select o_orderkey, true as ok, o_orderkey::bigint as value from orders")
def type_int16(spark, sf_dir):
    return _typed(table(spark, sf_dir, "orders"), "o_orderkey", F.concat(F.lit("0x"), F.hex("o_orderkey")), "int64_16")


@query("select o_orderkey, true as ok, o_orderkey::bigint as value from orders")
def type_int8(spark, sf_dir):
    return _typed(table(spark, sf_dir, "orders"), "o_orderkey", F.conv(F.col("o_orderkey").cast("string"), 10, 8), "int64_8")


@query("select o_orderkey, true as ok, o_orderkey::bigint as value from orders")
def type_int0(spark, sf_dir):
    key = F.col("o_orderkey")
    text = F.when(key % 3 == 0, F.concat(F.lit("0x"), F.hex(key))).when(key % 3 == 1, F.concat(F.lit("0"), F.conv(key.cast("string"), 10, 8))).otherwise(key.cast("string"))
    return _typed(table(spark, sf_dir, "orders"), "o_orderkey", text, "int64_0")


@query("select o_orderkey, true as ok, o_orderkey::bigint as value from orders")
def type_int10i(spark, sf_dir):
    return _typed(table(spark, sf_dir, "orders"), "o_orderkey", F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit("garbage")), "int64_10i")


@query("select o_orderkey, o_orderkey % 2 = 0 as ok, case when o_orderkey % 2 = 0 then (18446744073709551615::hugeint - o_orderkey)::decimal(20,0)::varchar end as value from orders")
def type_bits64(spark, sf_dir):
    key = F.col("o_orderkey")
    text = F.when(key % 2 == 0, (F.lit("18446744073709551615").cast("decimal(20,0)") - key).cast("decimal(20,0)").cast("string")).otherwise(F.concat(F.lit("-"), key.cast("string")))
    return _typed(table(spark, sf_dir, "orders"), "o_orderkey", text, "bits64_10", cast="string")


_FLOAT_TEXT = "case when o_orderkey % 6 = 0 then 'junk' when o_orderkey % 10 = 0 then '' else cast(cast(o_totalprice as decimal(18,2)) as varchar) end"


@query(f"select o_orderkey, t = '' or t <> 'junk' as ok, case when t = '' then 0 when t <> 'junk' then t::double end as value from (select o_orderkey, {_FLOAT_TEXT} as t from orders)")
def type_float(spark, sf_dir):
    return _typed(table(spark, sf_dir, "orders").withColumn("t", F.expr(_FLOAT_TEXT.replace("varchar", "string"))), "o_orderkey", F.col("t"), "float64")


@query(f"select o_orderkey, t = '' or t <> 'junk' as ok, case when t = '' then 0 when t <> 'junk' then trunc(t::double)::int end as value from (select o_orderkey, {_FLOAT_TEXT} as t from orders)")
def type_floatint_exact(spark, sf_dir):
    return _typed(table(spark, sf_dir, "orders").withColumn("t", F.expr(_FLOAT_TEXT.replace("varchar", "string"))), "o_orderkey", F.col("t"), "floatint32e")


@query("select o_orderkey, true as ok, least(greatest(trunc(p), -2147483647), 2147483647)::int as value from (select o_orderkey, (o_totalprice::decimal(18,2))::double * (case when o_orderkey % 2 = 0 then 100000 else -1 end) as p from orders)")
def type_floatint_saturate(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("double") * F.when(F.col("o_orderkey") % 2 == 0, 100000).otherwise(-1)
    return _typed(table(spark, sf_dir, "orders"), "o_orderkey", price.cast("string"), "floatint32s")


@query("select o_orderkey, true as ok, (o_orderkey::double + 0.5) as value from orders")
def type_numeric_comma(spark, sf_dir):
    return _typed(table(spark, sf_dir, "orders"), "o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(",5")), "float64", comma=True)


_WORDS = "case o_orderkey % 6 when 0 then 'FALSE' when 1 then 'no' when 2 then '' when 3 then 'yes' when 4 then '0' else 'OfF' end"


@query(f"select o_orderkey, true as ok, lower({_WORDS}) not in ('false', '0', 'f', 'no', 'off', 'nil', 'null', '') as value from orders")
def type_strbool(spark, sf_dir):
    return _typed(table(spark, sf_dir, "orders"), "o_orderkey", F.expr(_WORDS), "strbool")


@query("select o_orderkey, o_orderkey % 6 <> 5 as ok, case when o_orderkey % 6 <> 5 then o_orderkey % 6 in (0, 3) end as value from orders")
def type_floatbool(spark, sf_dir):
    return _typed(table(spark, sf_dir, "orders"), "o_orderkey", F.expr("case o_orderkey % 6 when 0 then '0.1' when 1 then '-0' when 2 then '' when 3 then 'inf' when 4 then '0.00' else 'x' end"), "floatbool")


@query("select o_orderkey, o_orderkey % 9 <> 0 as ok, case when o_orderkey % 9 <> 0 then o_orderdate::date end as value from orders")
def type_date(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 9 == 0, "2019-02-29").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return _typed(table(spark, sf_dir, "orders"), "o_orderkey", text, "date:%Y-%m-%d")


@query("select event_id, true as ok, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as value from events")
def type_datetime(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    t = converters.converter("datetime:%d/%m/%Y %H:%M:%S.%f")(F.date_format("ts", "dd/MM/yyyy HH:mm:ss.SSSSSS"))
    return events.select("event_id", t["ok"].alias("ok"), F.date_format(t["value"], "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("value"))


@query("select event_id, true as ok, strftime((date_trunc('second', ts) at time zone 'Europe/Stockholm') at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as value from events")
def type_datetime_tz(spark, sf_dir):
    t = converters.converter("datetime:%Y-%m-%d %H:%M:%S", timezone="Europe/Stockholm")(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", t["ok"].alias("ok"), F.date_format(t["value"], "yyyy-MM-dd HH:mm:ss").alias("value"))


@query("select event_id, true as ok, (epoch_us(ts) // 1000)::bigint as value from events")
def type_java_ms(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    t = converters.converter("datetime:%J")(ms)
    return table(spark, sf_dir, "events").select("event_id", t["ok"].alias("ok"), F.unix_millis(t["value"].cast("timestamp")).alias("value"))


@query("select event_id, true as ok, (extract(hour from ts) * 3600 + extract(minute from ts) * 60)::bigint * 1000000 as value from events")
def type_time(spark, sf_dir):
    return _typed(table(spark, sf_dir, "events"), "event_id", F.date_format("ts", "HH:mm"), "time:%H:%M")


@query("select doc_id, true as ok, trim(source) as value from documents")
def type_unicode_strip(spark, sf_dir):
    return _typed(table(spark, sf_dir, "documents"), "doc_id", F.concat(F.lit(" \t"), "source", F.lit("\n ")), "unicodestrip:utf-8")


@query("select doc_id, not regexp_matches(text, '[^\\x00-\\x7F]') as ok, case when not regexp_matches(text, '[^\\x00-\\x7F]') then length(text) end::bigint as value from documents")
def type_ascii_strict(spark, sf_dir):
    t = converters.converter("ascii:strict")(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t["ok"].alias("ok"), F.length(t["value"]).cast("long").alias("value"))


_OCTETS = "list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::int)"
_OCTAL = f"list_aggregate(list_transform({_OCTETS}, lambda b: case when b < 128 then chr(b) else chr(92) || (b // 64) || (b // 8 % 8) || (b % 8) end), 'string_agg', '')"


@query(f"select doc_id, h is not null as ok, case when h = '' then '' else {_OCTAL} end as value from (select doc_id, hex(encode(text)) as h from documents)")
def type_ascii_replace(spark, sf_dir):
    return _typed(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), "ascii")


@query("select event_id, true as ok, (props->>'$.k')::bigint as value from events")
def type_json(spark, sf_dir):
    t = converters.converter("json")(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", t["ok"].alias("ok"), F.get_json_object(t["value"], "$.k").cast("bigint").alias("value"))


@query("select o_orderkey, true as ok, case when o_orderkey % 2 = 0 then o_orderkey end as i, case when o_orderkey % 2 = 1 then o_orderkey + 0.25 end::double as d from orders")
def type_number(spark, sf_dir):
    key = F.col("o_orderkey")
    t = converters.converter("number")(F.concat(key.cast("string"), F.when(key % 2 == 0, ".00").otherwise(".25")))
    return table(spark, sf_dir, "orders").select("o_orderkey", t["ok"].alias("ok"), t["value"]["i"].cast("bigint").alias("i"), t["value"]["d"].alias("d"))


@query("select o_orderkey, true as ok, o_orderkey::double as re, 2::double as im from orders")
def type_complex(spark, sf_dir):
    out = _typed(table(spark, sf_dir, "orders"), "o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit("+2j")), "complex64")
    return out.select("o_orderkey", "ok", "value.re", "value.im")


def _orders_text(spark, sf_dir) -> DataFrame:
    rows = sliced(spark, sf_dir, "orders", "o_orderkey")
    return rows.select("_slice", "_pos", "o_orderkey", F.expr("case when o_orderkey % 17 = 0 then 'x' else cast(o_custkey as string) end").alias("a"), F.expr("case when o_orderkey % 13 = 0 then 'y' else '1.5' end").alias("b"))


@query("select o_orderkey, o_custkey::int as a, 1.5::double as b from orders where o_orderkey % 17 <> 0 and o_orderkey % 13 <> 0")
def type_filter_bad(spark, sf_dir):
    spec = typing.TypeSpec({"a": "int32_10", "b": "float64"}, filter_bad=True)
    return typing.dataset_type(_orders_text(spark, sf_dir), spec).drop("_slice", "_pos")


@query("select o_orderkey, case when o_orderkey % 17 = 0 then -1 else o_custkey end::int as a, case when o_orderkey % 13 <> 0 then 1.5 end::double as b from orders")
def type_defaults(spark, sf_dir):
    spec = typing.TypeSpec({"a": "int32_10", "b": "float64"}, defaults={"a": "-1", "b": None})
    return typing.dataset_type(_orders_text(spark, sf_dir), spec).drop("_slice", "_pos")


_BAD = "select (ord % 4)::int as slice, 'a' as column, ord // 4 as p from o where o_orderkey % 17 = 0 union all select (ord % 4)::int, 'b', ord // 4 from o where o_orderkey % 13 = 0"


@query("with o as " + ord_sql("orders", "o_orderkey") + f" select slice, \"column\", count(*) as bad, min(p)::bigint as first_line from ({_BAD}) group by all")
def bad_report(spark, sf_dir):
    spec = typing.TypeSpec({"a": "int32_10", "b": "float64"})
    return typing.bad_report(_orders_text(spark, sf_dir), spec).select(F.col("_slice").alias("slice"), "column", "bad", F.get("first_lines", F.lit(0)).alias("first_line"))


@query("select c_custkey as id, c_mktsegment as segment from customer")
def type_rename_discard(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_mktsegment", "c_name")
    spec = typing.TypeSpec({"key": "int64_10", "c_mktsegment": "unicode:utf-8"}, rename={"key": "id", "c_mktsegment": "segment"}, discard_untyped=True)
    return typing.dataset_type(rows, spec)


# ---- sorting ----

_L_KEY = ", ".join(LINE_KEY)
_L_ORD = ord_sql("lineitem", _L_KEY)


def _lines(spark, sf_dir) -> DataFrame:
    return sliced(spark, sf_dir, "lineitem", *LINE_KEY, columns=LINE_KEY)


@query(f"select ord, (ord % 4)::int as slice, row_number() over (partition by ord % 4 order by l_partkey, l_quantity, ord) - 1 as pos from {_L_ORD}")
def sort_within(spark, sf_dir):
    out = sorting.sort_within(_lines(spark, sf_dir).select("_ord", "_slice", "_pos", "l_partkey", "l_quantity"), ["l_partkey", "l_quantity"])
    return out.select(F.col("_ord").alias("ord"), F.col("_slice").alias("slice"), F.col("_pos").alias("pos"))


_ACROSS = """
with o as {o}, s as (select ord, row_number() over (order by {by}, ord % 4, ord // 4) - 1 as r, count(*) over () as n from o),
e as (select *, n // 4 as each, n % 4 as rest from s),
p as (select ord, r, case when r < rest * (each + 1) then r // (each + 1) else rest + (r - rest * (each + 1)) // each end as slice, each, rest from e)
select ord, slice::int as slice, (r - (slice * each + least(slice, rest)))::bigint as pos from p
"""


@query(_ACROSS.format(o=ord_sql("orders", "o_orderkey"), by="o_orderdate, o_totalprice"))
def sort_across(spark, sf_dir):
    rows = sliced(spark, sf_dir, "orders", "o_orderkey").withColumnRenamed("_ord", "ord")
    return sorting.sort_across(rows, ["o_orderdate", "o_totalprice"], N).select("ord", F.col("_slice").alias("slice"), F.col("_pos").alias("pos"))


@query(f"select ord, (ord % 4)::int as slice, row_number() over (partition by ord % 4 order by l_shipdate desc, ord) - 1 as pos from {_L_ORD}")
def sort_desc_stable(spark, sf_dir):
    out = sorting.sort_within(_lines(spark, sf_dir).select("_ord", "_slice", "_pos", "l_shipdate"), ["l_shipdate"], descending=True)
    return out.select(F.col("_ord").alias("ord"), F.col("_slice").alias("slice"), F.col("_pos").alias("pos"))


_HOLES = "case when event_id % 10 = 0 then null when event_id % 10 = 1 then 'nan'::double else value end"


@query(f"select event_id, (ord % 4)::int as slice, row_number() over (partition by ord % 4 order by case when v is null then '-inf'::double when isnan(v) then 'inf'::double else v end, ord) - 1 as pos from (select event_id, {_HOLES} as v, row_number() over (order by event_id) - 1 as ord from events)")
def sort_nulls_nan(spark, sf_dir):
    rows = sliced(spark, sf_dir, "events", "event_id", columns=["event_id", "value"])
    value = F.when(F.col("event_id") % 10 == 0, F.lit(None)).when(F.col("event_id") % 10 == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    return sorting.sort_within(rows.select("event_id", "_slice", "_pos", value.alias("v")), ["v"]).select("event_id", F.col("_slice").alias("slice"), F.col("_pos").alias("pos"))


_TRIGGER = """
with o as {o}, s as (select *, row_number() over (order by {by}) - 1 as r, count(*) over () as n from o),
c as (select r from (select r, {t} is distinct from lag({t}) over (order by r) as new from s) where new and r > 0),
w as (select k, k * (n // 4) + least(k, n % 4) as want, n from (select distinct n from s), range(1, 4) t(k)),
b as (select k, coalesce((select min(r) from c where r >= want), any_value(n)) as edge from w group by k, want)
select {id}, (select count(*) from b where b.edge <= s.r)::int as slice, (r - coalesce((select max(edge) from b where b.edge <= s.r), 0))::bigint as pos from s
"""


@query(_TRIGGER.format(o=ord_sql("orders", "o_orderkey"), by="o_custkey, ord % 4, ord // 4", t="o_custkey", id="o_orderkey"))
def sort_trigger(spark, sf_dir):
    rows = sliced(spark, sf_dir, "orders", "o_orderkey").drop("_ord")
    return sorting.sort_across(rows, ["o_custkey"], N, trigger="o_custkey").select("o_orderkey", F.col("_slice").alias("slice"), F.col("_pos").alias("pos"))


_SIZES = "select k, (select count(*) from o where ord % 4 < k) as want, (select count(*) from o) as n from range(1, 4) t(k)"


@query("with o as " + ord_sql("orders", "o_orderkey") + f", b as ({_SIZES}) select o_orderkey, (select count(*) from b where want <= ord)::int as slice, (ord - coalesce((select max(want) from b where want <= ord), 0))::bigint as pos from o")
def unroundrobin(spark, sf_dir):
    rows = sliced(spark, sf_dir, "orders", "o_orderkey").drop("_ord")
    lines = [r["lines"] for r in aggregate.lines_per_slice(rows).orderBy("_slice").collect()]
    return sorting.unroundrobin(rows, lines).select("o_orderkey", F.col("_slice").alias("slice"), F.col("_pos").alias("pos"))


@query("with o as " + ord_sql("orders", "o_orderkey") + f", w as ({_SIZES}), c as (select ord from (select ord, o_orderstatus is distinct from lag(o_orderstatus) over (order by ord) as new from o) where new and ord > 0), b as (select k, coalesce((select min(ord) from c where ord >= want), any_value(n)) as edge from w group by k, want) select o_orderkey, (select count(*) from b where edge <= ord)::int as slice, (ord - coalesce((select max(edge) from b where edge <= ord), 0))::bigint as pos from o")
def unroundrobin_trigger(spark, sf_dir):
    rows = sliced(spark, sf_dir, "orders", "o_orderkey").drop("_ord")
    lines = [r["lines"] for r in aggregate.lines_per_slice(rows).orderBy("_slice").collect()]
    return sorting.unroundrobin(rows, lines, trigger="o_orderstatus").select("o_orderkey", F.col("_slice").alias("slice"), F.col("_pos").alias("pos"))


# ---- partitioning ----

_MD5 = "(('0x' || substr(md5({c}::varchar), 1, 8))::bigint % 4)::int"


@query(f"select o_orderkey, {_MD5.format(c='o_custkey')} as slice from orders")
def hash_split_md5(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", md5_slice(F.col("o_custkey"), N).alias("slice"))


@query(f"with o as {ord_sql('orders', 'o_orderkey')} select o_orderkey, slice, row_number() over (partition by slice order by ord % 4, ord // 4) - 1 as pos from (select *, {_MD5.format(c='o_custkey')} as slice from o)")
def hashpart(spark, sf_dir):
    out = repartition.hashpart(sliced(spark, sf_dir, "orders", "o_orderkey"), "o_custkey", N)
    return out.select("o_orderkey", F.col("_slice").alias("slice"), F.col("_pos").alias("pos"))


_TEXT_CUSTOMER = "case when o_orderkey % 17 = 0 then 'x' else o_custkey::varchar end"
_TEXT_ORD = "(select *, o_orderkey % 3 as link, row_number() over (partition by o_orderkey % 3 order by o_orderkey) - 1 as ord from orders)"


@query(f"with o as (select *, {_MD5.format(c=_TEXT_CUSTOMER)} as slice from {_TEXT_ORD}) select o_orderkey, slice, row_number() over (partition by slice order by link, ord % 4, ord) - 1 as pos from o")
def hashpart_chain(spark, sf_dir):
    catalog = _text_chain(spark, sf_dir)
    ds = repartition.hashpart_chain(catalog, "hashed", "text-2", "customer")
    return catalog.read(ds, ["o_orderkey"]).withColumnsRenamed({"_slice": "slice", "_pos": "pos"})


@query(f"select o_orderkey, case when link < 2 then 0 else 1 + (ord % 4)::int end as link, {_MD5.format(c=_TEXT_CUSTOMER)} as slice from {_TEXT_ORD}")
def hashpart_as_chain(spark, sf_dir):
    catalog = _text_chain(spark, sf_dir)
    repartition.hashpart_chain(catalog, "early", "text-1", "customer")
    ds = repartition.hashpart_chain(catalog, "late", "text-2", "customer", previous="early", as_chain=True)
    return Scan(catalog, catalog.chain(ds.id), ["o_orderkey"], hashlabel="customer").frame().select("o_orderkey", F.col("_chain_ix").alias("link"), F.col("_slice").alias("slice"))


@query(f"select o_orderkey, (ord % 4)::int as slice, (link // 2)::int as link, row_number() over (partition by link // 2, ord % 4 order by o_orderstatus desc, link, ord) - 1 as pos from {_TEXT_ORD}")
def sort_chain(spark, sf_dir):
    catalog = _text_chain(spark, sf_dir)
    sorting.sort_chain(catalog, "early", "text-1", ["status"], descending=True)
    ds = sorting.sort_chain(catalog, "late", "text-2", ["status"], descending=True, previous="early")
    return Scan(catalog, catalog.chain(ds.id), ["o_orderkey"]).frame().withColumnsRenamed({"_slice": "slice", "_pos": "pos", "_chain_ix": "link"})


@query("select count(*) as keys, count(*) as placements, (select count(*) from orders) as n_rows from (select distinct o_custkey from orders)")
def hashpart_colocation(spark, sf_dir):
    placed = table(spark, sf_dir, "orders").withColumn("s", sip_slice(F.col("o_custkey"), N))
    pairs = placed.groupBy("o_custkey", "s").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(F.countDistinct("o_custkey").alias("keys"), F.count(F.lit(1)).alias("placements"), F.sum("n").alias("n_rows"))


@query()
def hash_sip_slices(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", sip_slice(F.col("c_name"), N).alias("slice"))


@query(f"select o_orderkey from orders where {_MD5.format(c='o_custkey')} = 1")
def rehash_iterate(spark, sf_dir):
    return _scan(spark, sf_dir, "orders", "o_orderkey", columns=["o_orderkey", "o_custkey"], hashlabel="o_custkey", rehash=lambda c: md5_slice(c, N), slice_=1).select("o_orderkey")


@query(f"with o as {ord_sql('orders', 'o_orderkey')} select o_orderkey from o where {_MD5.format(c='o_custkey')} = ord % 4")
def hash_discard(spark, sf_dir):
    return repartition.discard_wrong(sliced(spark, sf_dir, "orders", "o_orderkey"), "o_custkey", N).select("o_orderkey")


@query(f"select o_orderkey, (ord % 4)::int as slice from {ord_sql('orders', 'o_orderkey')}")
def roundrobin_split(spark, sf_dir):
    return sliced(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", F.col("_slice").alias("slice"))


# ---- combining ----


@query("select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders")
def merge_datasets(spark, sf_dir):
    catalog = Catalog(spark, slices=N)
    rows = sliced(spark, sf_dir, "orders", "o_orderkey")
    catalog.write("a", rows.select("_slice", "_pos", "o_orderkey", "o_custkey"))
    catalog.write("b", rows.select("_slice", "_pos", "o_orderstatus", "o_orderpriority"))
    return catalog.read(catalog.merge("m", ["a", "b"], allow_unrelated=True)).drop("_slice", "_pos")


@query("select o_orderkey, o_totalprice * 2 as double_price from orders")
def append_column(spark, sf_dir):
    catalog = Catalog(spark, slices=N)
    rows = sliced(spark, sf_dir, "orders", "o_orderkey")
    catalog.write("a", rows.select("_slice", "_pos", "o_orderkey"))
    catalog.write("b", rows.select("_slice", "_pos", (F.col("o_totalprice") * 2).alias("double_price")), parent="a")
    return catalog.read("b", ["o_orderkey", "double_price"]).drop("_slice", "_pos")


@query("select o_orderkey, 'new' as o_orderstatus from orders")
def overlap_wins(spark, sf_dir):
    catalog = Catalog(spark, slices=N)
    rows = sliced(spark, sf_dir, "orders", "o_orderkey")
    catalog.write("a", rows.select("_slice", "_pos", "o_orderkey", "o_orderstatus"))
    catalog.write("b", rows.select("_slice", "_pos", F.lit("new").alias("o_orderstatus")), parent="a")
    return catalog.read(catalog.merge("m", ["a", "b"])).drop("_slice", "_pos")


# ---- aggregation ----


@query("select l_returnflag, sum(l_linenumber)::bigint as l_linenumber from lineitem group by 1")
def agg_number(spark, sf_dir):
    return aggregate.merge_number(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber")


@query("select l_partkey, count(*) as n from lineitem group by 1")
def agg_counter(spark, sf_dir):
    return aggregate.merge_counter(table(spark, sf_dir, "lineitem"), "l_partkey")


@query("select distinct l_returnflag, l_linestatus from lineitem")
def agg_set(spark, sf_dir):
    return aggregate.merge_set(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus")


@query(f"select n_regionkey, string_agg(n_name, ',' order by ord % 4, ord // 4) as names from {ord_sql('nation', 'n_nationkey')} group by 1")
def agg_list(spark, sf_dir):
    return aggregate.merge_list(sliced(spark, sf_dir, "nation", "n_nationkey"), ["n_regionkey"], "n_name").select("n_regionkey", F.array_join("n_name", ",").alias("names"))


@query(f"select o_custkey, arg_max(o_orderkey, (ord % 4) * 1000000000 + ord // 4) as o_orderkey from {ord_sql('orders', 'o_orderkey')} group by 1")
def agg_dict_overwrite(spark, sf_dir):
    return aggregate.merge_dict(sliced(spark, sf_dir, "orders", "o_orderkey"), "o_custkey", "o_orderkey")


@query("select event_type, min(value) as low, max(value) as high from events group by 1")
def minmax(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"))


@query(f"select event_type, min(v) filter (where not isnan(v)) as low, max(v) filter (where not isnan(v)) as high from (select event_type, {_HOLES} as v from events) group by 1")
def minmax_nan(spark, sf_dir):
    value = F.when(F.col("event_id") % 10 == 0, F.lit(None)).when(F.col("event_id") % 10 == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").withColumn("v", value)
    return rows.groupBy("event_type").agg(least(F.col("v")).alias("low"), largest(F.col("v")).alias("high"))


@query("select min(o_totalprice) as low, max(o_totalprice) as high from orders")
def chain_minmax(spark, sf_dir):
    catalog, links = order_chain(spark, sf_dir)
    chain = catalog.chain(links[-1].id)
    return spark.createDataFrame([(chain.low("o_totalprice"), chain.high("o_totalprice"))], "low double, high double")


@query(f"select (ord % 4)::int as slice, count(*) as lines from {ord_sql('orders', 'o_orderkey')} group by 1")
def lines_per_slice(spark, sf_dir):
    return aggregate.lines_per_slice(sliced(spark, sf_dir, "orders", "o_orderkey")).withColumnRenamed("_slice", "slice")


@query(f"select slice, lines, round(lines * 100.0 / sum(lines) over (), 6)::double as percent from (select {_MD5.format(c='o_custkey')} as slice, count(*) as lines from orders group by 1)")
def slice_balance(spark, sf_dir):
    placed = table(spark, sf_dir, "orders").withColumn("_slice", md5_slice(F.col("o_custkey"), N))
    return aggregate.slice_balance(placed).select(F.col("_slice").alias("slice"), "lines", F.round("percent", 6).cast("double").alias("percent"))


@query("select c as column, (select max(year(o_orderdate)) - min(year(o_orderdate)) + 1 from orders)::bigint as links from (values ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderpriority'), ('day')) t(c)")
def column_counts(spark, sf_dir):
    catalog, links = order_chain(spark, sf_dir)
    return spark.createDataFrame(list(catalog.chain(links[-1].id).column_counts().items()), "column string, links long")


_DIGEST = "md5(o_custkey || chr(1) || o_orderkey || chr(1) || o_orderstatus || chr(1))"
_DIGESTED = ["o_orderkey", "o_custkey", "o_orderstatus"]


@query(f"select md5(string_agg(h, '' order by h)) as checksum from (select {_DIGEST} as h from orders)")
def checksum_sorted(spark, sf_dir):
    return aggregate.checksum_sorted(table(spark, sf_dir, "orders"), _DIGESTED)


@query(f"select md5(string_agg({_DIGEST}, '' order by ord % 4, ord // 4)) as checksum from {ord_sql('orders', 'o_orderkey')}")
def checksum_unsorted(spark, sf_dir):
    return aggregate.checksum_ordered(sliced(spark, sf_dir, "orders", "o_orderkey", columns=_DIGESTED), _DIGESTED, ["_slice", "_pos"])


@query("select sum(('0x' || substr(md5(o_custkey || chr(1) || o_orderkey || chr(1)), 1, 15))::bigint::hugeint)::varchar as checksum, count(*) as n_rows from orders")
def checksum_sum(spark, sf_dir):
    out = aggregate.checksum_sum(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"])
    return out.withColumn("checksum", F.col("checksum").cast("string"))


_XOR = " || ".join(f"printf('%08x', bit_xor(('0x' || substr(sum, {k}, 8))::bigint))" for k in (1, 9, 17, 25))
_ORDER_DIGEST = "md5(o_custkey || chr(1) || o_orderkey || chr(1))"


@query(f"select {_XOR} as checksum from (select md5(string_agg(h, '' order by h)) as sum from (select year(o_orderdate) as y, {_ORDER_DIGEST} as h from orders) where y between 1997 and 2000 group by y)")
def checksum_chain(spark, sf_dir):
    catalog, _ = order_chain(spark, sf_dir)
    return spark.createDataFrame([(aggregate.checksum_of_chain(catalog, "orders-2000", ["o_orderkey", "o_custkey"], stop="orders-1996"),)], "checksum string")


# ---- chains that are typed, and catalogs that are opened again ----


def _text_chain(spark, sf_dir) -> Catalog:
    """Orders as text in three links by remainder of the key; every seventeenth customer is no number."""
    catalog, before = Catalog(spark, slices=N), None
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("case when o_orderkey % 17 = 0 then 'x' else cast(o_custkey as string) end").alias("customer"), F.col("o_orderstatus").alias("status"))
    for k in range(3):
        before = catalog.write(f"text-{k}", deal(number_rows(orders.where(F.col("o_orderkey") % 3 == k), "o_orderkey"), N).drop("_ord"), previous=before).id
    return catalog


_CUSTOMER = typing.TypeSpec({"customer": "int64_10"}, rename={"customer": "c"}, filter_bad=True, discard_untyped=False)


@query(f"select o_orderkey, o_custkey as c, o_orderstatus as status, (ord % 4)::int as slice, row_number() over (partition by ord % 4 order by link, ord) - 1 as pos from {_TEXT_ORD} where o_orderkey % 17 <> 0")
def type_chain(spark, sf_dir):
    catalog = _text_chain(spark, sf_dir)
    ds = typing.type_chain(catalog, "typed", "text-2", _CUSTOMER)
    return catalog.read(ds).withColumnsRenamed({"_slice": "slice", "_pos": "pos"})


@query(f"select o_orderkey, o_custkey as c, link::int as link from {_TEXT_ORD} where o_orderkey % 17 <> 0")
def type_chain_previous(spark, sf_dir):
    catalog = _text_chain(spark, sf_dir)
    for k in range(3):  # each link is typed when it is there, those before it are not typed again
        typing.type_chain(catalog, f"typed-{k}", f"text-{k}", _CUSTOMER, previous=f"typed-{k - 1}" if k else None)
    return Scan(catalog, catalog.chain("typed-2"), ["o_orderkey", "c"]).frame().select("o_orderkey", "c", F.col("_chain_ix").alias("link"))


@query(f"with o as (select *, {_MD5.format(c='o_custkey')} as slice from {_TEXT_ORD} where o_orderkey % 17 <> 0) select o_orderkey, o_custkey as c, slice, row_number() over (partition by slice order by link, ord % 4, ord) - 1 as pos from o")
def type_rehash(spark, sf_dir):
    catalog = _text_chain(spark, sf_dir)
    ds = typing.type_chain(catalog, "typed", "text-2", _CUSTOMER, hashlabel="c")
    return catalog.read(ds, ["o_orderkey", "c"]).withColumnsRenamed({"_slice": "slice", "_pos": "pos"})


@query(f"select o_orderkey, o_custkey as c, (ord % 4)::int as link, {_MD5.format(c='o_custkey')} as slice from {_TEXT_ORD} where o_orderkey % 17 <> 0")
def type_as_chain(spark, sf_dir):
    catalog = _text_chain(spark, sf_dir)
    ds = typing.type_chain(catalog, "typed", "text-2", _CUSTOMER, as_chain=True, hashlabel="c")
    return Scan(catalog, catalog.chain(ds.id), ["o_orderkey", "c"]).frame().select("o_orderkey", "c", F.col("_chain_ix").alias("link"), F.col("_slice").alias("slice"))


@query("select o_orderkey from orders where o_orderkey >= 9 and o_orderkey < 1000")
def range_reopened(spark, sf_dir):
    catalog, before = Catalog(spark, slices=N), None
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("decimal(20,0)").alias("wide"))
    for k in range(5):
        before = catalog.write(f"part-{k}", deal(number_rows(orders.where(F.expr(f"o_orderkey div 200 {'>=' if k == 4 else '='} {k}")), "o_orderkey"), N).drop("_ord"), previous=before).id
    again = Catalog(spark, catalog.root, slices=N)
    return Scan(again, again.chain(list(again.known)[-1]), ["o_orderkey"], range_={"wide": (9, 1000)}).frame().select("o_orderkey")


# ---- text in and out ----


def _exported(spark, df: DataFrame, options: export.ExportOptions | None = None, suffix: str = "") -> str:
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex[:12]}{suffix}"
    export.write_csv(df, path, options)
    return path


def _imported(spark, sf_dir, options: csv.CsvOptions, suffix: str = "") -> csv.Imported:
    rows = sliced(spark, sf_dir, "orders", "o_orderkey")
    rows = rows.select(F.lit(0).alias("_slice"), F.col("_ord").alias("_pos"), "o_orderkey", "o_orderstatus")
    status = F.when(F.col("o_orderkey") % 50 == 0, F.lit("a,b")).otherwise(F.col("o_orderstatus"))
    return csv.read_csv(spark, _exported(spark, rows.withColumn("o_orderstatus", status), suffix=suffix), options, N)


def _text(c: str) -> Column:
    return F.col(c).cast("string").alias(c)


@query("select o_orderkey::varchar as o_orderkey, o_orderstatus from orders where o_orderkey % 50 <> 0")
def csv_roundtrip(spark, sf_dir):
    return _imported(spark, sf_dir, csv.CsvOptions(allow_bad=True), ".gz").good.select(_text("o_orderkey"), _text("o_orderstatus"))


@query(f"select o_orderkey::varchar as o_orderkey, ord + 2 as lineno, (ord % 4)::int as slice from {ord_sql('orders', 'o_orderkey')} where o_orderkey % 50 <> 0")
def csv_lineno(spark, sf_dir):
    return _imported(spark, sf_dir, csv.CsvOptions(allow_bad=True, lineno_label="lineno")).good.select(_text("o_orderkey"), "lineno", F.col("_slice").alias("slice"))


@query(f"select ord + 2 as lineno, o_orderkey || ',a,b' as data from {ord_sql('orders', 'o_orderkey')} where o_orderkey % 50 = 0")
def csv_bad(spark, sf_dir):
    return _imported(spark, sf_dir, csv.CsvOptions(allow_bad=True)).bad.select("lineno", _text("data"))


@query(f"select ord + 2 as lineno, o_orderkey || ',' || case when o_orderkey % 50 = 0 then 'a,b' else o_orderstatus end as data from {ord_sql('orders', 'o_orderkey')} where o_orderkey::varchar like '1%'")
def csv_skipped(spark, sf_dir):
    return _imported(spark, sf_dir, csv.CsvOptions(allow_bad=True, comment="1")).skipped.select("lineno", _text("data"))


@query("select 'x' || n as file, n::varchar as v from (values (1), (2)) t(n)")
def csv_zip(spark, sf_dir):
    import os
    import tempfile
    import zipfile

    with tempfile.TemporaryDirectory() as d:
        path = os.path.join(d, "x.zip")
        with zipfile.ZipFile(path, "w") as z:
            for n in (1, 2):
                z.writestr(f"x{n}", f"v\n{n}\n")
        got = csv.read_zip(spark, path)
    first, second = (got[k].good.select(F.lit(k).alias("file"), _text("v")) for k in ("x1", "x2"))
    return first.unionAll(second)


@query("""select c_custkey, '"' || c_custkey || '","' || replace(c_name, '"', '""') || '"' as line from customer""")
def csv_export_quoting(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_pos"), "c_custkey", "c_name")
    return export.lines(rows, export.ExportOptions(quote_fields='"')).select(F.col("_pos").alias("c_custkey"), "line")


@query("""select c_custkey, c_custkey || '#' || case when contains(c_name, '#') then '"' || c_name || '"' else c_name end as line from customer""")
def csv_export_lazy(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_pos"), "c_custkey", "c_name")
    return export.lines(rows, export.ExportOptions(separator="#", quote_fields='"', lazy_quotes=True)).select(F.col("_pos").alias("c_custkey"), "line")


@query("select c_custkey, c_custkey || ',' || case when c_custkey % 3 = 0 then 'nil' else c_name end as line from customer")
def csv_export_none_as(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_pos"), "c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("c_name"))
    return export.lines(rows, export.ExportOptions(none_as="nil")).select(F.col("_pos").alias("c_custkey"), "line")


@query("select o_orderkey::varchar || ',' || o_orderstatus as line from orders union all select 'o_orderkey,o_orderstatus'")
def csv_export_chain(spark, sf_dir):
    catalog, links = order_chain(spark, sf_dir)
    return spark.read.text(_exported(spark, Scan(catalog, links, ["o_orderkey", "o_orderstatus"]).frame())).select(F.col("value").alias("line"))


@query("select o_orderkey::varchar || ',' || o_orderstatus as line from orders where year(o_orderdate) >= 1999 union all select 'o_orderkey,o_orderstatus'")
def csv_export_incremental(spark, sf_dir):
    catalog, links = order_chain(spark, sf_dir)
    o, paths = export.ExportOptions(labels=["o_orderkey", "o_orderstatus"]), [f"{shared_dir(spark)}/csv-{uuid.uuid4().hex[:12]}" for _ in range(2)]
    done = export.export_chain(catalog, links[3].id, paths[0], o)
    export.export_chain(catalog, links[-1].id, paths[1], o, exported=done.id)
    return spark.read.text(paths[1]).select(F.col("value").alias("line"))


@query("select case when o_orderkey % 2 = 0 then o_orderkey || ',True' else o_orderkey || ',1' end as line from orders union all select 'key,flag'")
def csv_export_changing_types(spark, sf_dir):
    catalog = Catalog(spark, slices=N)
    rows = sliced(spark, sf_dir, "orders", "o_orderkey").select("_ord", F.col("o_orderkey").alias("key"))
    for k, (kind, flag) in enumerate((("long", F.lit(True)), ("string", F.lit(1)))):
        link = rows.where(F.col("key") % 2 == k).withColumns({"key": F.col("key").cast(kind), "flag": flag}).drop("_ord")
        catalog.write(f"part-{k}", deal(number_rows(link, F.col("key").cast("long")), N).drop("_ord"), previous="part-0" if k else None)
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex[:12]}"
    export.export_chain(catalog, "part-1", path, export.ExportOptions(labels=["key", "flag"]))
    return spark.read.text(path).select(F.col("value").alias("line"))


def _imported_chain(spark, sf_dir) -> Catalog:
    """Orders in two files by remainder of the key, imported as two links; lines of keys by 50 are bad."""
    catalog, before = Catalog(spark, slices=N), None
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("case when o_orderkey % 50 < 2 then 'a,b' else o_orderstatus end").alias("o_orderstatus"))
    for k in range(2):
        rows = number_rows(orders.where(F.col("o_orderkey") % 2 == k), "o_orderkey", name="_pos").withColumn("_slice", F.lit(0))
        before = csv.import_link(catalog, f"file-{k}", _exported(spark, rows), csv.CsvOptions(allow_bad=True), before).id
    return catalog


@query("select o_orderkey::varchar as o_orderkey, o_orderstatus, (o_orderkey % 2)::int as link from orders where o_orderkey % 50 >= 2")
def csv_import_chain(spark, sf_dir):
    catalog = _imported_chain(spark, sf_dir)
    return Scan(catalog, catalog.chain("file-1")).frame().select(_text("o_orderkey"), _text("o_orderstatus"), F.col("_chain_ix").alias("link"))


@query("select o_orderkey || ',a,b' as data, (o_orderkey % 2)::int as link from orders where o_orderkey % 50 < 2")
def csv_import_chain_bad(spark, sf_dir):
    catalog = _imported_chain(spark, sf_dir)
    return Scan(catalog, catalog.chain("file-1/bad"), ["data"]).frame().select(_text("data"), F.col("_chain_ix").alias("link"))


def _customers_text(spark, sf_dir) -> str:
    """Customers with every field quoted and semicolons and quotes in their names."""
    rows = number_rows(table(spark, sf_dir, "customer"), "c_custkey", name="_pos").select(F.lit(0).alias("_slice"), "_pos", "c_custkey", "c_nationkey", F.replace("c_name", F.lit("#"), F.lit('";"')).alias("c_name"))
    return _exported(spark, rows, export.ExportOptions(separator=";", quote_fields='"', labels=["c_custkey", "c_name", "c_nationkey"]))


@query("""select c_custkey::varchar as key, replace(c_name, '#', '";"') as c_name from customer""")
def csv_quotes(spark, sf_dir):
    o = csv.CsvOptions(separator=";", quotes='"', rename={"c_custkey": "key"}, discard={"c_nationkey"})
    return csv.read_csv(spark, _customers_text(spark, sf_dir), o, N).good.select(_text("key"), _text("c_name"))


@query(f"""select c_custkey::varchar as a, replace(c_name, '#', '";"') as b, c_nationkey::varchar as c, ((ord + 1) % 4)::int as slice from {ord_sql('customer', 'c_custkey')} where ord >= 2""")
def csv_skip_lines(spark, sf_dir):
    o = csv.CsvOptions(separator=";", quotes=True, labelsonfirstline=False, labels=[" a", "b ", "c"], strip_labels=True, skip_lines=3)
    return csv.read_csv(spark, _customers_text(spark, sf_dir), o, N).good.select(_text("a"), _text("b"), _text("c"), F.col("_slice").alias("slice"))


# ---- inspection, log, extensions ----


@query("select doc_id from documents where regexp_matches(text, 'th[aeiou]{2}')")
def grep_regex(spark, sf_dir):
    return inspect.grep(table(spark, sf_dir, "documents"), "th[aeiou]{2}", ["text"]).select("doc_id")


@query("select doc_id from documents where regexp_matches(text, '(?i)licensed UNDER')")
def grep_ignorecase(spark, sf_dir):
    return inspect.grep(table(spark, sf_dir, "documents"), "licensed UNDER", ["text"], ignore_case=True).select("doc_id")


@query("select p_partkey from part where regexp_matches(p_name, '1+2') or regexp_matches(p_type, '1+2') or regexp_matches(p_brand, '1+2')")
def grep_columns(spark, sf_dir):
    return inspect.grep(table(spark, sf_dir, "part"), "1+2", ["p_name", "p_type", "p_brand"], python=True).select("p_partkey")


@query("select 'o_orderkey' as column, 'bigint' as type, min(o_orderkey)::varchar as low, max(o_orderkey)::varchar as high from orders union all select 'o_orderstatus', 'string', null, null")
def ds_report(spark, sf_dir):
    catalog = Catalog(spark, slices=N)
    catalog.write("o", sliced(spark, sf_dir, "orders", "o_orderkey").select("_slice", "_pos", "o_orderkey", "o_orderstatus"))
    rows = [(r["column"], r["type"], None if r["low"] is None else str(r["low"]), None if r["high"] is None else str(r["high"])) for r in inspect.report(catalog, "o")]
    return spark.createDataFrame(rows, "column string, type string, low string, high string")


def _log():
    from slicewright.jobs import JobList, BuildLog

    log = BuildLog()
    for at in ("2016-10-01", "2016-10-02", "2016-10-05"):
        log.begin("ab/test", at)
        log.finish(JobList())
    log.begin("ab/child", 1)
    log.get("ab/test", "latest")
    log.finish(JobList())
    return log


@query("select 'latest' as what, '2016-10-05' as stamp union all select '<=2016-10-04', '2016-10-02' union all select '<2016-10-02', '2016-10-01' union all select '>2016-10-02', '2016-10-05' union all select 'first', '2016-10-01'")
def log_asof(spark, sf_dir):
    log = _log()
    return spark.createDataFrame([(w, log.peek("ab/test", w).timestamp) for w in ("latest", "<=2016-10-04", "<2016-10-02", ">2016-10-02", "first")], "what string, stamp string")


@query("select * from (values ('2016-10-02'), ('2016-10-05')) t(stamp)")
def log_since(spark, sf_dir):
    return spark.createDataFrame([(t,) for t in _log().since("ab/test", "2016-10-01")], "stamp string")


@query("select * from (values ('ab/child', '1'), ('ab/test', '2016-10-05')) t(key, stamp)")
def log_ghost(spark, sf_dir):
    log = _log()
    log.truncate("ab/test", "2016-10-05")
    return spark.createDataFrame([(g.key, str(g.timestamp)) for g in log.ghosts], "key string, stamp string")


@query("select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def extension_join(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return extensions.key_join(table(spark, sf_dir, "orders"), customers, "o_custkey").select("o_orderkey", "c_mktsegment")


@query("select a.event_id, max(b.event_id) as last_click from events a left join events b on a.user_id = b.user_id and b.event_type = 'click' and (b.ts < a.ts or b.ts = a.ts) and b.ts = (select max(c.ts) from events c where c.user_id = a.user_id and c.event_type = 'click' and c.ts <= a.ts) group by 1")
def extension_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_click"))
    return extensions.asof_join(events.select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "last_click").select("event_id", "last_click")


@query("select o_orderpriority, round(sum(o_totalprice), 2) as total, count(*) as n from orders where o_orderdate >= '1996-06-01' and o_orderdate < '1998-03-01' group by 1")
def flagship(spark, sf_dir):
    """Orders as text in yearly links, typed, the range pruned to links, then summed by priority."""
    import datetime as dt

    catalog = Catalog(spark, slices=N)
    orders = table(spark, sf_dir, "orders")
    text = orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_totalprice").cast("string").alias("price"), "o_orderpriority")
    spec = typing.TypeSpec({"day": "date:%Y-%m-%d", "price": "float64"})
    links = []
    for year in years_of(text, "day"):
        rows = deal(number_rows(text.where(F.year("day") == year), "o_orderkey"), N).drop("_ord")
        links.append(catalog.write(f"typed-{year}", typing.dataset_type(rows, spec), previous=links[-1].id if links else None))
    scan = Scan(catalog, catalog.chain(links[-1].id), ["o_orderpriority", "price"], range_={"day": (dt.date(1996, 6, 1), dt.date(1998, 3, 1))})
    return scan.frame().groupBy("o_orderpriority").agg(F.round(F.sum("price"), 2).alias("total"), F.count(F.lit(1)).alias("n"))
