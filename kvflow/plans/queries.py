"""Registered queries of the reference operators, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvflow.functions import strings
from kvflow.operators import aggregates as G
from kvflow.operators import filters as P
from kvflow.operators import indexing, joins, keyspec, kmeans, linalg, partition, project, search, sets, sorting
from kvflow.plans import pipe
from kvflow.plans.store import written
from kvflow.sources import readers
from kvflow.streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: A unique order of lineitem.
LINE_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
LINE_SQL = ", ".join(LINE_ORDER)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS_SQL = r"select unnest(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '')) as token from documents"


@query(f"select token, count(*)::bigint as n from ({WORDS_SQL}) group by token")
def word_count(spark, d):
    return project.token_counts(table(spark, d, "documents"), "text")


@query(f"select 'LongValueSum' as kind, token as id, count(*)::varchar as result from ({WORDS_SQL}) group by token")
def aggregate_word_count(spark, d):
    docs = table(spark, d, "documents").select(F.explode(project.tokens(F.col("text"))).alias("token"))
    return G.dynamic_aggregates(docs, F.array(G.emit(G.LONG_SUM, F.col("token"), F.lit(1))), kinds={G.LONG_SUM})


@query(r"""with t as (select unnest(case when len(p) = 1 then p else list_slice(p, 1, coalesce(list_max(list_filter(range(1, len(p) + 1), lambda i: p[i] <> '')), 0)) end) as w
    from (select regexp_split_to_array(text, '[ |\t]') as p from documents)), c as (select w, count(*) as n from t group by w)
    select count(*)::bigint as n_unique, min(n)::bigint as "min", list_sort(list(n))[count(*) // 2 + 1]::bigint as median, max(n)::bigint as "max", round(avg(n), 6) as mean, round(stddev_pop(n), 6) as sd from c""")
def word_histogram(spark, d):
    words = table(spark, d, "documents").select(F.explode(project.fields(F.col("text"), r"[ |\t]")).alias("w"))
    return G.histogram_report(words, [], "w").select("n_unique", "min", "median", "max", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(r"""select "match", n, row_number() over (order by n desc, "match") as "rank" from (select "match", count(*)::bigint as n from (select unnest(regexp_extract_all(text, '([a-z]+)tion', 1)) as "match" from documents) group by 1)""")
def grep_count_desc(spark, d):
    counted = project.regex_tokens(table(spark, d, "documents"), "text", "([a-z]+)tion", 1).groupBy("match").agg(F.count("*").alias("n"))
    ranked = partition.global_index(counted.withColumn("_d", -F.col("n")), ["_d", "match"])
    return ranked.select("match", "n", F.col("_i").cast("long").alias("rank"))


@query(r"select doc_id, len(regexp_extract_all(text, 'th[ae]'))::bigint as hits from documents where regexp_matches(text, 'th[ae]')")
def grep_lines(spark, d):
    return P.matching_lines(table(spark, d, "documents"), "text", "th[ae]").select("doc_id", "hits")


@query("select p_partkey, p_brand from part where regexp_full_match(p_brand, 'Brand#[1-3][0-9]*')")
def key_regex_full_filter(spark, d):
    return table(spark, d, "part").where(P.key_matches(F.col("p_brand"), "Brand#[1-3][0-9]*")).select("p_partkey", "p_brand")


@query(f"select {LINE_SQL} from (select *, row_number() over (order by {LINE_SQL}) as i from lineitem) where (i - 1) % 10 = 0")
def every_nth(spark, d):
    return P.every_nth(table(spark, d, "lineitem").select(*LINE_ORDER), LINE_ORDER, 10)


MD5_SQL = "case when u >= 9223372036854775808 then u::hugeint - 18446744073709551616 else u::hugeint end"


@query(f"select c_custkey, c_name from (select *, ('0x' || substr(md5(c_custkey::varchar), 1, 16))::ubigint as u from customer) where ({MD5_SQL}) % 7 = 0")
def md5_sample(spark, d):
    return P.md5_sample(table(spark, d, "customer"), "c_custkey", 7).select("c_custkey", "c_name")


@query("select count(*)::bigint as n_members, 0::bigint as n_lost, true as few_others from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def bloom_membership(spark, d):
    """The filter keeps all members, and of the others 6 % at most (and five)."""
    orders, customers = table(spark, d, "orders").where("o_orderstatus = 'P'"), table(spark, d, "customer").select("c_custkey")
    return _filtered(customers, orders, P.bloom_semi_join(customers, "c_custkey", orders, "o_custkey"))


def _filtered(customers, orders, kept):
    told = customers.join(orders.select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("member")).distinct(), "c_custkey", "left")
    told = told.join(kept.select("c_custkey", F.lit(True).alias("kept")), "c_custkey", "left").select(F.col("member").isNotNull().alias("member"), F.col("kept").isNotNull().alias("kept"))
    n = lambda c: F.count(F.when(c, 1))
    return told.agg(n(F.col("member")).alias("n_members"), n(F.col("member") & ~F.col("kept")).alias("n_lost"), (n(~F.col("member") & F.col("kept")) <= 0.06 * n(~F.col("member")) + 5).alias("few_others"))


@query("select event_type, count(*)::bigint as n from events group by event_type")
def page_view_count(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""select l_returnflag, count(*)::bigint as n, sum(l_linenumber)::bigint as long_sum, round(sum(l_extendedprice), 2) as double_sum, max(l_partkey)::bigint as long_max, min(l_partkey)::bigint as long_min,
    max(l_linestatus) as string_max, min(l_linestatus) as string_min, count(distinct l_suppkey)::bigint as n_unique from lineitem group by l_returnflag""")
def multi_aggregate(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.try_sum("l_linenumber").alias("long_sum"), F.round(F.sum("l_extendedprice"), 2).alias("double_sum"), F.max("l_partkey").alias("long_max"), F.min("l_partkey").alias("long_min"),
        F.max("l_linestatus").alias("string_max"), F.min("l_linestatus").alias("string_min"), F.countDistinct("l_suppkey").alias("n_unique"),
    )


@query("select l_returnflag, least(count(distinct l_partkey), 101)::bigint as n_unique, least(count(distinct l_suppkey), 1000001)::bigint as n_unbound from lineitem group by 1")
def unique_capped(spark, d):
    lines = table(spark, d, "lineitem")
    free = G.unique_capped(lines, ["l_returnflag"], "l_suppkey", 1_000_000).withColumnRenamed("n_unique", "n_unbound")
    return G.unique_capped(lines, ["l_returnflag"], "l_partkey", 100).join(free, "l_returnflag").select("l_returnflag", F.col("n_unique").cast("long").alias("n_unique"), F.col("n_unbound").cast("long").alias("n_unbound"))


@query("""with c as (select event_type, user_id, count(*) as n from events group by all)
    select event_type, count(*)::bigint as n_unique, min(n)::bigint as "min", list_sort(list(n))[count(*) // 2 + 1]::bigint as median, max(n)::bigint as "max", round(avg(n), 6) as mean, round(stddev_pop(n), 6) as sd from c group by 1""")
def value_histogram(spark, d):
    return G.histogram_report(table(spark, d, "events"), ["event_type"], "user_id").select("event_type", "n_unique", "min", "median", "max", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("""select 'LongValueSum' as kind, 'lines_' || l_returnflag as id, count(*)::varchar as result from lineitem group by l_returnflag
    union all select 'LongValueMax', 'line', max(l_linenumber)::varchar from lineitem union all select 'LongValueMin', 'line', min(l_linenumber)::varchar from lineitem
    union all select 'StringValueMax', 'status', max(l_linestatus) from lineitem union all select 'StringValueMin', 'status', min(l_linestatus) from lineitem
    union all select 'UniqValueCount', 'part_' || l_linestatus, least(count(distinct l_partkey), 151)::varchar from lineitem group by l_linestatus""")
def dynamic_aggregates(spark, d):
    lines = table(spark, d, "lineitem")
    entries = F.array(
        G.emit(G.LONG_SUM, F.concat(F.lit("lines_"), "l_returnflag"), F.lit(1)), G.emit(G.LONG_MAX, "line", F.col("l_linenumber")), G.emit(G.LONG_MIN, "line", F.col("l_linenumber")),
        G.emit(G.STRING_MAX, "status", F.col("l_linestatus")), G.emit(G.STRING_MIN, "status", F.col("l_linestatus")), G.emit(G.UNIQUE_COUNT, F.concat(F.lit("part_"), "l_linestatus"), F.col("l_partkey")),
    )
    return G.dynamic_aggregates(lines, entries, 150, {G.LONG_SUM, G.LONG_MAX, G.LONG_MIN, G.STRING_MAX, G.STRING_MIN, G.UNIQUE_COUNT})


@query("select 'nation.parquet' as id, count(*)::bigint as n from nation union all select 'region.parquet', count(*) from region union all select 'record_count', (select count(*) from nation) + (select count(*) from region)")
def record_counts(spark, d):
    """Rows of each input file and of all: two files read as one input."""
    both = spark.read.schema("n_name string").parquet(f"{d}/nation.parquet", f"{d}/region.parquet")
    return G.record_counts(both).select(F.regexp_extract("id", r"([a-z_]+(?:\.parquet)?)(?:/[^/]*)?$", 1).alias("id"), "n")


@query("""select count(*)::bigint as n_rows, sum(octet_length(t::blob))::bigint as n_bytes, bit_xor(('0x' || substr(md5(t), 1, 15))::bigint) as xor_hash
    from (select l_orderkey::varchar || chr(1) || l_linenumber::varchar || chr(1) || l_returnflag as t from lineitem)""")
def shuffle_checksum(spark, d):
    return G.shuffle_checksum(table(spark, d, "lineitem").repartition("l_partkey"), "l_orderkey", "l_linenumber", "l_returnflag")


@query("select o_orderkey as key, o_custkey, l_linenumber, l_partkey from orders join lineitem on o_orderkey = l_orderkey")
def inner_join(spark, d):
    out = joins.inner("k", o=table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey"), l=table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey"))
    return out.select("key", "o.o_custkey", "l.l_linenumber", "l.l_partkey")


@query("""select coalesce(c_custkey, o_custkey) as key, c_custkey is not null as has_customer, o_custkey is not null as has_order, c_name, o_orderkey
    from (select * from customer where c_acctbal > 0) full join (select * from orders where o_orderstatus = 'P') on c_custkey = o_custkey""")
def outer_join(spark, d):
    out = joins.outer("k", c=table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), "c_name"), o=table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), "o_orderkey"))
    return out.select("key", F.col("c").isNotNull().alias("has_customer"), F.col("o").isNotNull().alias("has_order"), "c.c_name", "o.o_orderkey")


@query("""with u as (select c_custkey as k, c_nationkey::bigint as v, 0 as src from customer union all select o_custkey, o_orderkey, 1 from orders where o_orderstatus = 'P')
    select k, v, src from (select *, max(src) over (partition by k) as top from u) where src = top""")
def override_join(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("v"))
    return joins.override("k", customers, table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))).select("k", "v", "src")


@query("""select coalesce(a.k, b.k) as k, a.r_name, a.n_name, b.c from (select r_regionkey as k, r_name, n_name from region join (select n_regionkey, n_name from nation) on r_regionkey = n_regionkey where r_regionkey < 4) a
    full join (select n_regionkey as k, count(*)::bigint as c from nation where n_regionkey > 0 group by 1) b on a.k = b.k""")
def nested_join(spark, d):
    nation = table(spark, d, "nation")
    sources = {
        "r": table(spark, d, "region").where("r_regionkey < 4").select(F.col("r_regionkey").alias("k"), "r_name"), "n": nation.select(F.col("n_regionkey").alias("k"), "n_name"),
        "c": nation.where("n_regionkey > 0").groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("c")),
    }
    out = joins.JoinExpression("k", sources).run("outer(inner(tbl(r),tbl(n)),tbl(c))")
    return out.select("k", "s2_0.s1_0.r_name", "s2_0.s1_1.n_name", "s2_1.c")


@query("select c_custkey as key from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def left_semi_by_presence(spark, d):
    return joins.semi("key", *_presence(spark, d))


@query("select c_custkey as key from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def left_anti_by_presence(spark, d):
    return joins.semi("key", *_presence(spark, d), absent=True)


@query("""select coalesce(c_custkey, o_custkey) as key from (select distinct c_custkey from customer where c_mktsegment = 'BUILDING') full join (select distinct o_custkey from orders where o_orderstatus = 'P') on c_custkey = o_custkey
    where c_custkey is null or o_custkey is null""")
def user_join_one_side(spark, d):
    """A join of one's own by presence flags: keys that exactly one source has."""
    customers = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    orders = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).distinct()
    return joins.present(joins.outer("k", c=customers, o=orders), lambda f: f["c"] != f["o"]).select("key")


def _presence(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key")), table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"))


@query("""select o_orderkey as key, o_orderpriority || '|' || coalesce(a.l_partkey::varchar, '-') || '|' || coalesce(r.l_partkey::varchar, '-') as value from orders
    left join (select l_orderkey, l_partkey from lineitem where l_returnflag = 'A') a on a.l_orderkey = o_orderkey left join (select l_orderkey, l_partkey from lineitem where l_returnflag = 'R') r on r.l_orderkey = o_orderkey""")
def tagged_join_three(spark, d):
    lines = lambda flag: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("k"), "l_partkey")
    part = lambda tag: F.coalesce(tag["l_partkey"].cast("string"), F.lit("-"))
    combine = lambda t: F.when(t["o"].isNotNull(), F.concat_ws("|", t["o"]["o_orderpriority"], part(t["a"]), part(t["r"])))
    return joins.tagged_join_many("k", combine, o=table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority"), a=lines("A"), r=lines("R"))


@query("select c_custkey as key, c_custkey::varchar || chr(9) || c_name || chr(9) || o_orderkey::varchar as value from customer join orders on c_custkey = o_custkey")
def tagged_join_concat(spark, d):
    left, right = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name"), table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    both = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("\t", F.col("key").cast("string"), a["c_name"], b["o_orderkey"].cast("string")))
    return joins.tagged_join(left, right, "k", both)


@query(f"""select o_orderkey as key, o_custkey::varchar || ':' || l_linenumber::varchar || ':' || l_partkey::varchar as value from orders join (select *, row_number() over (partition by l_orderkey order by {LINE_SQL}) as rn from lineitem) on o_orderkey = l_orderkey where rn <= 2""")
def tagged_join_capped(spark, d):
    left, right = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), *LINE_ORDER[1:])
    both = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(":", a["o_custkey"].cast("string"), b["l_linenumber"].cast("string"), b["l_partkey"].cast("string")))
    return joins.tagged_join(left, right, "k", both, 2, (["o_custkey"], LINE_ORDER[1:]))


@query("select n_name || '-' || '' as key, r_name || '-' || n_nationkey::varchar || '-' || n_name || '-' || r_name as value from nation join region on n_regionkey = r_regionkey")
def field_select(spark, d):
    lines = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("-", F.col("n_nationkey").cast("string"), "n_name", "r_name").alias("line"))
    return project.field_select(lines, "line", "1,7:2,0-")


@query("select p_name as key, p_partkey as value, row_number() over (order by p_name, p_partkey) as rank from part")
def inverse_sort(spark, d):
    return partition.global_index(project.swapped(table(spark, d, "part"), "p_partkey", "p_name"), ["key", "value"]).select("key", "value", F.col("_i").cast("long").alias("rank"))


@query("select p_partkey, p_brand, rank() over (order by regexp_extract(p_brand, '#([0-9]+)', 1)::double desc)::int as rank from part")
def key_field_sort(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    # distinct keys are ranked by the rows before them, range by range; every row then gets its key's rank
    number = keyspec.region_number(F.col("p_brand"), keyspec.parse("-k2,2n")[0], "#")
    counted = part.groupBy("p_brand").agg(F.count("*").alias("n")).withColumn("_down", -number)
    upto = partition.running_total(counted, ["_down", "p_brand"], "n")
    first = upto.groupBy("_down").agg(F.min(F.col("_run") - F.col("n")).alias("before"))
    return part.join(upto.select("p_brand", "_down"), "p_brand").join(first, "_down").select("p_partkey", "p_brand", (F.col("before") + 1).cast("int").alias("rank"))


@query("select p_partkey, row_number() over (order by length(p_name) desc, reverse(p_name), p_partkey) as place from part")
def comparator_sort(spark, d):
    """An order of one's own: longer names first, equal lengths by their ends."""
    return sorting.sort_with(table(spark, d, "part").select("p_partkey", "p_name"), -F.length("p_name"), F.reverse("p_name"), F.col("p_partkey")).select("p_partkey", F.col("place").cast("long").alias("place"))


@query(f"""with n as (select greatest(1, ceil(count(*) / 100000.0))::bigint as f from orders), s as (select v from (select o_totalprice as v, ('0x' || substr(md5(o_totalprice::varchar), 1, 16))::ubigint as u from orders), n where ({MD5_SQL}) % f = 0),
    u as (select v, sum(count(*)) over (order by v) as upto, count(*) as c from s group by v), q as (select i, (2 * (select count(*) from s) * i + 8) // 16 as q from (select unnest(range(1, 8)) as i)),
    cuts as (select distinct min(v) as cut from q join u on u.upto > q.q group by i)
    select (select count(*) from cuts where cut <= o_totalprice)::int as part, count(*)::bigint as n, min(o_totalprice) as lo, max(o_totalprice) as hi from orders group by 1""")
def sampled_range_sort(spark, d):
    """Cut points from a sample of the keys, rows dealt by them: the ranges in order are the sorted whole."""
    orders = table(spark, d, "orders").select("o_totalprice")
    part = partition.range_of(F.col("o_totalprice"), partition.sampled_cuts(orders, "o_totalprice", 8))
    return orders.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@query(f"select {LINE_SQL}, row_number() over (partition by l_suppkey order by l_quantity desc, {LINE_SQL}) as rank from lineitem")
def secondary_sort(spark, d):
    return sorting.secondary_sort(table(spark, d, "lineitem").withColumn("_down", -F.col("l_quantity")), "l_suppkey", ["_down", *LINE_ORDER]).select(*LINE_ORDER, "rank")


@query("select len(list_filter([50000.0, 100000.0, 200000.0], lambda c: c <= o_totalprice))::int as part, count(*)::bigint as n from orders group by 1")
def range_partition_counts(spark, d):
    return table(spark, d, "orders").groupBy(partition.range_of(F.col("o_totalprice"), [50000.0, 100000.0, 200000.0]).alias("part")).agg(F.count("*").alias("n"))


@query("select len(list_filter([10.0, 20.0, 30.0], lambda c: c < l_quantity))::int as part, count(*)::bigint as n from lineitem group by 1")
def range_partition_left(spark, d):
    return table(spark, d, "lineitem").groupBy(partition.range_left_of(F.col("l_quantity"), [10.0, 20.0, 30.0]).alias("part")).agg(F.count("*").alias("n"))


@query(f"select {LINE_SQL} from (select *, row_number() over (order by {LINE_SQL}) as i from lineitem) where ceil(i * 3 / 10.0) > ceil((i - 1) * 3 / 10.0)")
def interval_sample(spark, d):
    return partition.interval_sample(table(spark, d, "lineitem").select(*LINE_ORDER), 3, 10, LINE_ORDER)


@query("select o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_orderstatus order by o_orderkey) as i from orders) where i <= 5")
def split_sample(spark, d):
    return partition.first_of_splits(table(spark, d, "orders"), 5, ["o_orderkey"], F.col("o_orderstatus")).select("o_orderkey", "o_orderstatus")


@query("select o_orderkey, unnest([1 for q in range((floor((i * 116 + 99) / 100) - floor(((i - 1) * 116 + 99) / 100))::int)]) as one from (select *, row_number() over (order by o_orderkey) as i from orders)")
def keep_percent(spark, d):
    return partition.keep_percent(table(spark, d, "orders").select("o_orderkey"), 116, ["o_orderkey"]).withColumn("one", F.lit(1))


@query("select count(*)::bigint as n, 0::bigint as misplaced from lineitem")
def total_sort_validate(spark, d):
    ordered = sorting.total_sort(table(spark, d, "lineitem").select("l_extendedprice"), "l_extendedprice")
    placed = written(ordered.select("l_extendedprice", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")), "sorted")  # sorted once, read twice
    bad = sorting.validate_order(placed, "l_extendedprice", F.col("part"), F.col("pos")).agg(F.count("*").alias("misplaced"))
    return placed.agg(F.count("*").alias("n")).withColumn("misplaced", bad.scalar())


@query("select 2::bigint as misplaced")
def sort_validator_faults(spark, d):
    """The validator finds what is out of order: one row inside a partition, one partition before its place."""
    rows = spark.createDataFrame([(0, 1, 1), (0, 2, 5), (0, 3, 4), (1, 1, 2), (1, 2, 9)], "part int, pos int, key int")
    return sorting.validate_order(rows, "key", F.col("part"), F.col("pos")).agg(F.count("*").alias("misplaced"))


@query("select l_shipmode, n, row_number() over (order by n desc, l_shipmode) as rank from (select l_returnflag || l_linestatus as l_shipmode, count(*)::bigint as n from lineitem group by 1)")
def frequency_sort(spark, d):
    counted = sorting.frequencies(table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode")), "l_shipmode")
    return partition.global_index(counted.withColumn("_down", -F.col("n")), ["_down", "l_shipmode"]).select("l_shipmode", "n", F.col("_i").cast("long").alias("rank"))


@query("select user_id, n from (select user_id, count(*)::bigint as n from events group by 1) order by n desc, user_id limit 20")
def top_users(spark, d):
    return sorting.by_frequency(table(spark, d, "events"), "user_id", 20)


COO_SQL = "select {a} % 7 as {x}, {b} % 11 as {y}, sum(l_quantity) as v from lineitem group by 1, 2"


@query(f"select i, j, round(sum(a.v * b.v), 2) as v from ({COO_SQL.format(a='l_suppkey', b='l_partkey', x='i', y='k')}) a join ({COO_SQL.format(a='l_orderkey', b='l_partkey', x='j', y='k')}) b using (k) group by i, j")
def matmul_coo(spark, d):
    lines = table(spark, d, "lineitem")
    coo = lambda a, x, b, y: lines.groupBy((F.col(a) % 7).alias(x), (F.col(b) % 11).alias(y)).agg(F.sum("l_quantity").alias("v"))
    return linalg.matmul(coo("l_suppkey", "i", "l_partkey", "k"), coo("l_orderkey", "j", "l_partkey", "k")).select("i", "j", F.round("v", 2).alias("v"))


@query("""with b as (select n_nationkey % 3 as i, n_nationkey % 2 as j, n_nationkey as x from nation), c as (select i, j, x, unnest(range(4)) as p from b), r as (select 2 * i + r as row, 2 * j + c as col, (x + 2 * r + k) * (x + 2 * k + c + 1) as v
    from (select *, p // 2 as r, p % 2 as k from c), (select unnest(range(2)) as c)) select row::bigint as row, col::bigint as col, sum(v)::double as v from r group by row, col""")
def block_matmul(spark, d):
    x = F.col("n_nationkey")
    cells = [*[x + k for k in range(4)], *[x + k + 1 for k in range(4)]]
    line = F.concat_ws(" ", *[c.cast("string") for c in ((x % 3), (x % 2), F.lit(0), F.lit(2), F.lit(2), *cells)])
    return linalg.block_matmul_lines(table(spark, d, "nation").select(line.alias("line")), "line")


@query("select (c_custkey % 5)::bigint as i, (c_custkey % 4)::bigint as j, sum(c_nationkey * c_custkey + 2.0 * 3.0)::double as v from customer group by 1, 2")
def matmul_lines(spark, d):
    c = F.col("c_custkey")
    line = F.concat_ws(" ", *[e.cast("string") for e in (c % 5, c % 4, F.col("c_nationkey"), F.lit(2), c, F.lit(3))])
    return linalg.matmul_lines(table(spark, d, "customer").select(line.alias("line")), "line")


def _kmeans_sql(rounds: int, cols: tuple[str, ...], start: list[tuple[float, ...]], source: str, last: str) -> str:
    values = ", ".join(f"({k}, {', '.join(f'{v}::double' for v in c)})" for k, c in enumerate(start))
    names = [f"c{i}" for i in range(len(cols))]
    text = f"with p as (select row_number() over () as id, {', '.join(f'{c}::double as x{i}' for i, c in enumerate(cols))} from {source}), m0(cid, {', '.join(names)}) as (values {values})"
    far = " + ".join(f"(x{i} - c{i}) * (x{i} - c{i})" for i in range(len(cols)))
    for r in range(rounds):
        text += f", a{r} as (select * from (select *, row_number() over (partition by id order by {far}, cid) as rn from p, m{r}) where rn = 1), m{r + 1} as (select cid, {', '.join(f'avg(x{i}) as c{i}' for i in range(len(cols)))}, count(*) as n from a{r} group by cid)"
    return text + f" select cid::int as cluster, {last}, n::bigint as n from m{rounds}"


START_1D, START_2D = [(1000.0,), (150000.0,), (400000.0,)], [(1.0, 1000.0), (25.0, 30000.0), (50.0, 90000.0)]


@query(_kmeans_sql(10, ("o_totalprice",), START_1D, "orders", "round(c0, 4) as x"))
def kmeans_1d_fixed(spark, d):
    out = kmeans.kmeans(table(spark, d, "orders").select(F.col("o_totalprice").alias("x")), ["x"], START_1D, 10, None)
    return out.where("n > 0").select("cluster", F.round("x", 4).alias("x"), "n")


@query(_kmeans_sql(1, ("l_quantity", "l_extendedprice"), START_2D, "lineitem", "round(c0, 4) as x, round(c1, 4) as y"))
def kmeans_2d_step(spark, d):
    points = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return kmeans.step(points, ["x", "y"], START_2D).select("cluster", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "n")


@query()
def kmeans_2d(spark, d):
    """Until no centroid moves by more than 1, or 100 rounds; tests compare with a plain loop."""
    points = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return kmeans.kmeans(points, ["x", "y"], START_2D).where("n > 0").select("cluster", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "n")


LINES_1D = "select o_custkey as g, o_orderkey, floor(o_totalprice / 1000)::int as p from orders"


@query(f"""with p as ({LINES_1D}), o as (select g, p, row_number() over (partition by g order by o_orderkey) as id from p), line as (select g, '2 ' || count(*)::varchar || ' 50 300 ' || string_agg(p::varchar, ' ' order by id) as key from o group by g),
    c0 as (select g, unnest([0, 1]) as cid, unnest([50.0::double, 300.0::double]) as x from line)"""
+ "".join(f""", a{r} as (select g, p, cid from (select o.g, o.id, o.p, cid, row_number() over (partition by o.g, o.id order by (p - x) * (p - x), cid) as rn from o join c{r} on o.g = c{r}.g where x is not null) where rn = 1),
    c{r + 1} as (select g, cid, s as x from (select c{r}.g, c{r}.cid, (select avg(p) from a{r} where a{r}.g = c{r}.g and a{r}.cid = c{r}.cid) as s from c{r}))""" for r in range(10))
+ " select key, cid::int as cluster, round(x, 6) as x from c10 join line using (g)")
def kmeans_1d_lines(spark, d):
    """One problem a line: two centroids and a customer's order values, ten rounds."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("int").alias("p"))
    grouped = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "p"))).alias("o"))
    line = F.concat_ws(" ", F.lit("2"), F.size("o").cast("string"), F.lit("50 300"), F.array_join(F.transform("o", lambda e: e["p"].cast("string")), " "))
    out = kmeans.kmeans_lines(grouped.select(line.alias("line")), "line", 1)
    return out.select("key", "cluster", F.round("x", 6).alias("x"))


@query("""with recursive h as (select id, id as i2, 0.5::double as f2, 0.0::double as v2, id as i3, (1.0 / 3.0)::double as f3, 0.0::double as v3, 0 as r from (select unnest(range(1, 5001)) as id)
    union all select id, i2 // 2, f2 / 2.0, v2 + (i2 % 2) * f2, i3 // 3, f3 / 3.0, v3 + (i3 % 3) * f3, r + 1 from h where r < 16)
    select sum(case when (v2 - 0.5) * (v2 - 0.5) + (v3 - 0.5) * (v3 - 0.5) <= 0.25 then 1 else 0 end)::bigint as n_inside, count(*)::bigint as n_total, 4.0::double * sum(case when (v2 - 0.5) * (v2 - 0.5) + (v3 - 0.5) * (v3 - 0.5) <= 0.25 then 1 else 0 end) / count(*) as pi from h where r = 16""")
def pi_halton(spark, d):
    return search.pi_estimate(spark, 5000)


@query("select distinct c_nationkey as k from customer union select s_nationkey from supplier")
def union_distinct(spark, d):
    return sets.distinct(sets.union_all(*_nations(spark, d)))


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def intersect(spark, d):
    return sets.intersect(*_nations(spark, d))


@query("select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'P'")
def difference(spark, d):
    return sets.difference(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")))


@query("select c_nationkey as k from customer except all select s_nationkey from supplier")
def difference_all(spark, d):
    return sets.difference(*_nations(spark, d), keep_copies=True)


def _nations(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))


POSTINGS_SQL = "count(distinct doc_id)::bigint as n_docs, array_to_string(list_transform(list_sort(list(distinct doc_id)), lambda x: x::varchar), ',') as docs"


@query(f"select token as term, doc_id // 65536 as segment, {POSTINGS_SQL} from (select doc_id, {WORDS_SQL[len('select '):]}) group by token, segment")
def inverted_index_segments(spark, d):
    return indexing.inverted_index(table(spark, d, "documents"), "doc_id", "text")


@query(f"select token as term, {POSTINGS_SQL} from (select doc_id, {WORDS_SQL[len('select '):]}) group by token")
def inverted_index(spark, d):
    """Small segments, merged."""
    return indexing.merge_segments(indexing.inverted_index(table(spark, d, "documents"), "doc_id", "text", segment_docs=4096))


@query(f"""select token as term, {POSTINGS_SQL} from (select doc_id, {WORDS_SQL[len('select '):].replace(' from documents', '')} from (select doc_id, case when lang = 'de' then lower(text) else text end as text from documents where lang <> 'fr')) group by token""")
def index_update(spark, d):
    """French documents are deleted and German ones replaced by their lower case in a finished index."""
    docs = table(spark, d, "documents")
    built = indexing.inverted_index(docs, "doc_id", "text")
    again = docs.where("lang = 'de'").select("doc_id", F.lower("text").alias("text"))
    return indexing.merge_segments(indexing.updated_index(built, docs.where("lang = 'fr'").select("doc_id"), again, "doc_id", "text"))


OPS_SQL = "select user_id as doc, event_id as seq, case when event_type in ('click', 'view') then 'insert' else 'delete' end as op from events"


@query(f"select doc, arg_max(op, seq) as op, max(seq)::bigint as seq from ({OPS_SQL}) group by doc")
def doc_ops_latest(spark, d):
    return indexing.latest(_ops(spark, d), "doc", "seq").select("doc", "op", "seq")


def _ops(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("click", "view"), "insert").otherwise("delete").alias("op"))


@query(f"select shard::int as shard, op, count(*)::bigint as n from (select op, unnest(case when op = 'delete' then range(4) else [seq % 4] end) as shard from ({OPS_SQL})) group by all")
def doc_ops_routed(spark, d):
    return indexing.route(_ops(spark, d), "doc", "op", 4, "seq").groupBy("shard", "op").agg(F.count("*").alias("n"))


@query("""with s as (select l_suppkey, count(*) as load from lineitem group by 1), r as (select *, sum(load) over (order by load desc, l_suppkey rows unbounded preceding) as run, sum(load) over () as total from s)
    select count(*)::bigint as n_workers, sum(case when run - load < 0.9 * total then 1 else 0 end)::bigint as busy, round(1 - sum(case when run - load < 0.9 * total then 1 else 0 end)::double / count(*), 6) as imbalance from r""")
def reduce_skew_diagnosis(spark, d):
    stats = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("load"))
    return indexing.skew_report(stats, "load").withColumn("imbalance", F.round("imbalance", 6))


@query("select strftime(ts, '%Y-%m-%d') as date, case when event_type = 'error' then 'ERROR' else 'INFO' end as level, 'mod.' || event_type as source, 'user ' || user_id::varchar as message from events")
def log_parse(spark, d):
    e = table(spark, d, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",123 "), level, F.lit(" mod."), "event_type", F.lit(": user "), F.col("user_id").cast("string"))
    return indexing.parse_logs(e.select(line.alias("line")), "line").select("date", "level", "source", "message")


@query("select event_type as key, props as value from events where props is not null")
def key_value_split(spark, d):
    line = F.concat(F.col("event_type"), F.lit("\t"), F.col("props"))
    key, value = project.split_first(F.col("line"))
    return table(spark, d, "events").where("props is not null").select(line.alias("line")).select(key.alias("key"), value.alias("value"))


@query("select date_trunc('day', ts) as window_start, event_type, count(*)::bigint as n from events group by all")
def windowed_page_views(spark, d):
    return stream.windowed_counts(table(spark, d, "events"), "event_type").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


SIZE_SQL = "case when {c} < 1024 then {c}::varchar when {c} < 1048576 then printf('%.1fk', floor({c} * 10 / 1024.0 + 0.5) / 10) when {c} < 1073741824 then printf('%.1fm', floor({c} * 10 / 1048576.0 + 0.5) / 10) else printf('%.1fg', floor({c} * 10 / 1073741824.0 + 0.5) / 10) end"


@query(f"select c_custkey, {SIZE_SQL.format(c='c_custkey')} as size, {SIZE_SQL.format(c='(c_custkey * c_custkey * 1000)')} as large, replace(replace(c_name, '&', '&amp;'), '<', '&lt;') as html, lower(hex(c_mktsegment)) as hex from customer")
def string_functions(spark, d):
    key, wide = F.col("c_custkey"), F.col("c_custkey") * F.col("c_custkey") * 1000
    return table(spark, d, "customer").select("c_custkey", strings.human_readable(key).alias("size"), strings.human_readable(wide).alias("large"), strings.escape_html(F.col("c_name")).alias("html"), strings.bytes_to_hex(F.col("c_mktsegment").cast("binary")).alias("hex"))


@query("""select event_id, list_filter(string_split(props, ','), lambda p: p <> '') as parts, case when event_id % 86400 >= 3600 then (event_id % 86400 // 3600)::varchar || 'hrs, ' else '' end || case when event_id % 86400 >= 60 then (event_id % 3600 // 60)::varchar || 'mins, ' else '' end || (event_id % 60)::varchar || 'sec' as taken,
    replace(replace(props, '\\', '\\\\'), ',', '\\,') as escaped, props as back from events where props is not null""")
def text_escapes(spark, d):
    """Escaping and its inverse, splitting, and durations."""
    e = table(spark, d, "events").where("props is not null")
    escaped = strings.escape(F.col("props"))
    return e.select("event_id", strings.split_string(F.col("props"), ",").alias("parts"), strings.time_difference((F.col("event_id") % 86400) * 1000).alias("taken"), escaped.alias("escaped"), strings.unescape(escaped).alias("back"))


@query("select count(*)::bigint as n_keys, 0::bigint as n_below, 0::bigint as n_lost, true as few_above, true as few_after from (select distinct o_custkey from orders)")
def bloom_counts(spark, d):
    """A counting filter never counts below the truth, seldom above, and after deletions loses no key that is left and
    few that are gone."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    n_keys = orders.agg(F.approx_count_distinct("o_custkey").alias("n")).first()["n"]
    bits = 1 << max(16, (16 * n_keys).bit_length())
    counted = P.counting_filter(orders, "o_custkey", bits)
    true = orders.groupBy("o_custkey").agg(F.count("*").alias("n_true"), F.count(F.when(F.col("o_orderstatus") != "P", 1)).alias("n_left"))
    about = P.approximate_counts(orders, "o_custkey", counted, bits).withColumnRenamed("key", "o_custkey")
    left = P.approximate_counts(orders, "o_custkey", P.filter_without(counted, orders.where("o_orderstatus = 'P'"), "o_custkey", bits), bits).select(F.col("key").alias("o_custkey"), F.col("n").alias("n_after"))
    both = true.join(about, "o_custkey", "left").join(left, "o_custkey", "left").fillna(0, ["n", "n_after"])
    n = lambda c: F.count(F.when(c, 1))
    few = lambda c: n(c) <= 0.02 * F.count("*") + 5
    return both.agg(F.count("*").alias("n_keys"), n(F.col("n") < F.col("n_true")).alias("n_below"), n(F.col("n_after") < F.col("n_left")).alias("n_lost"), few(F.col("n") > F.col("n_true")).alias("few_above"), few(F.col("n_after") > F.col("n_left")).alias("few_after"))


@query("select count(*)::bigint as n_members, 0::bigint as n_lost, true as few_others from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def dynamic_bloom_membership(spark, d):
    orders, customers = table(spark, d, "orders").where("o_orderstatus = 'P'"), table(spark, d, "customer").select("c_custkey")
    slices = P.slices_for(orders, "o_custkey")
    return _filtered(customers, orders, P.dynamic_semi_join(customers, "c_custkey", P.dynamic_filter(orders, "o_custkey", slices), slices))


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey >= 100 and o_orderkey < 400")
def map_range_scan(spark, d):
    return readers.map_range(table(spark, d, "orders"), "o_orderkey", 100, 400).select("o_orderkey", "o_custkey", "o_totalprice")


@query("select (select max(o_orderkey) from orders where o_orderkey <= 250) as before_key, (select min(o_orderkey) from orders where o_orderkey >= 250) as after_key, (select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) as i, count(*) over () as n from orders) where i = (n - 1) // 2 + 1) as mid_key")
def map_closest_keys(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    before, after = readers.map_closest(orders, "o_orderkey", 250, True), readers.map_closest(orders, "o_orderkey", 250)
    one = [before.select(F.lit(1).alias("one"), F.col("o_orderkey").alias("before_key")), after.select(F.lit(1).alias("one"), F.col("o_orderkey").alias("after_key")), readers.map_middle(orders, "o_orderkey").select(F.lit(1).alias("one"), "mid_key")]
    return one[0].join(one[1], "one").join(one[2], "one").drop("one")


@query("select unnest(regexp_extract_all(html, '(?s)<p>.*?</p>')) as key, '' as value from pages")
def marked_records(spark, d):
    return readers.marked_records(table(spark, d, "pages"), "html", "<p>", "</p>")


@query("select kind, id, result from (select 'LongValueSum' as kind, o_orderstatus as id, count(*)::varchar as result from orders group by 2 union all select 'LongValueMax', 'largest', max(o_custkey)::varchar from orders)")
def text_aggregate_lines(spark, d):
    orders = table(spark, d, "orders")
    pair = F.array(F.concat(F.lit("LongValueSum:"), "o_orderstatus", F.lit("\t1")), F.concat(F.lit("LongValueMax:largest\t"), F.col("o_custkey").cast("string")))
    return G.text_aggregates(orders.select(F.explode(pair).alias("line")), "line", kinds={G.LONG_SUM, G.LONG_MAX})


@query("select upper(n_name) as key, n_nationkey::varchar as value from nation")
def stream_command(spark, d):
    """Lines through a process of one's own, key and value by tab."""
    lines = table(spark, d, "nation").select(F.concat_ws("\t", "n_name", F.col("n_nationkey").cast("string")).alias("line"))
    return pipe.map_command(lines, "line", ["tr", "a-z", "A-Z"])


@query("select n_nationkey as number, upper(n_name) as name from nation")
def typed_csv_records(spark, d):
    lines = table(spark, d, "nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), F.upper("n_name")).alias("line"))
    return readers.typed_records(lines, "line", "number int, name string")


@query("select c_custkey, c_name, n_name from customer join nation on c_nationkey = n_nationkey")
def replicated_join(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    customers = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", "c_name")
    return joins.replicated_join(customers, nations, "k").select("c_custkey", "c_name", "n_name")


@query("select count(distinct split_part(p_brand, '#', 2))::bigint as n_regions, 0::bigint as n_split from part")
def key_field_partition(spark, d):
    """Rows that agree in the key's region share a partition."""
    dealt = keyspec.partition_by_spec(table(spark, d, "part").select("p_brand"), "p_brand", "-k2,2", 4, "#")
    placed = dealt.select(F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("region"), F.spark_partition_id().alias("p"))
    per = placed.groupBy("region").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    return per.agg(F.count("*").alias("n_regions"), F.count(F.when(F.col("lo") < F.col("hi"), 1)).alias("n_split"))


@query("select c_custkey, octet_length(c_name::blob)::int as n_bytes, unicode(c_name[3]) as code from customer")
def text_positions(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", strings.utf8_length(F.col("c_name")).alias("n_bytes"), strings.char_at(F.col("c_name"), 2).alias("code"))


