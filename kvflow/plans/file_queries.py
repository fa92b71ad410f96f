"""Registered queries of sources, sinks, jobs over files and functions of one's own: what is written is read back."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from kvflow.functions import strings
from kvflow.operators import aggregates as G
from kvflow.operators import indexing, joins, partition, project, search, sorting
from kvflow.plans import pipe
from kvflow.plans.queries import WORDS_SQL, query, table
from kvflow.plans.store import new_path
from kvflow.sources import readers, writers


@query("select event_type as key, coalesce(props, '') as value from events")
def text_sink(spark, d):
    """Lines of key and value, compressed; a null value leaves its separator out and comes back empty."""
    path = new_path(spark, "pairs")
    writers.write_pairs(table(spark, d, "events"), path, "event_type", "props", codec="gzip")
    return readers.key_value_lines(spark, path)


@query("select c_name as value from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and octet_length(c_name::blob) <= 18")
def text_lines_by_glob(spark, d):
    """One folder a segment, two of them read by a glob, long lines left out."""
    path = new_path(spark, "segments")
    writers.write_by(table(spark, d, "customer"), path, F.col("c_mktsegment"), "text", keep=[F.col("c_name").alias("value")])
    return readers.text_lines(spark, path + "/leaf={BUILDING,MACHINERY}", max_length=18).select("value")


@query("select n_nationkey::int as key, n_name as value from nation")
def sequence_sink(spark, d):
    path = new_path(spark, "sequence")
    writers.write_sequence_file(table(spark, d, "nation"), path, "n_nationkey", "n_name")
    return readers.sequence_file(spark, path, schema="key int, value string")


@query("select n_nationkey::varchar as key, n_name as value from nation")
def sequence_as_text(spark, d):
    path = new_path(spark, "sequence")
    writers.write_sequence_file(table(spark, d, "nation"), path, "n_nationkey", "n_name")
    return readers.sequence_file(spark, path, as_text=True)


@query("select lower(hex(n_nationkey::varchar)) as key, lower(hex(n_name)) as value from nation")
def sequence_as_binary(spark, d):
    path = new_path(spark, "sequence")
    writers.write_sequence_file(table(spark, d, "nation"), path, "n_nationkey", "n_name")
    return readers.sequence_file_binary(spark, path).select(F.lower(F.hex("key")).alias("key"), F.lower(F.hex("value")).alias("value"))


@query("""select (select o_custkey from orders where o_orderkey = 77) as found, (select max(o_orderkey) from orders where o_orderkey <= 250) as before_key, (select min(o_orderkey) from orders where o_orderkey >= 250) as after_key,
    (select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) as i, count(*) over () as n from orders) where i = (n - 1) // 2 + 1) as mid_key, exists (select 1 from orders where o_orderkey = 77) as has_it, false as has_none""")
def map_file_lookups(spark, d):
    """A sorted map, written and asked: a key, the nearest keys, the middle key, and whether keys may be there."""
    path = new_path(spark, "map")
    writers.write_map(table(spark, d, "orders").select("o_orderkey", "o_custkey"), path, "o_orderkey")
    kept = spark.read.parquet(path)
    one = lambda df, c, name: df.agg(F.max(c).alias(name))
    out = one(readers.map_get(kept, "o_orderkey", 77), "o_custkey", "found")
    for df, c, name in ((readers.map_closest(kept, "o_orderkey", 250, True), "o_orderkey", "before_key"), (readers.map_closest(kept, "o_orderkey", 250), "o_orderkey", "after_key"), (readers.map_middle(kept, "o_orderkey"), "mid_key", "mid_key")):
        out = out.withColumn(name, one(df, c, name).scalar())
    return out.withColumn("has_it", F.lit(readers.map_probably_has(spark, path, "o_orderkey", 77))).withColumn("has_none", F.lit(readers.map_probably_has(spark, path, "o_orderkey", -5)))


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 77")
def hashed_map_lookup(spark, d):
    path = new_path(spark, "hashed")
    writers.write_hashed_map(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path, "o_orderkey", 4)
    return readers.hashed_map_get(spark, path, "o_orderkey", 77, 4)


@query("select 'c' || c_custkey::varchar as key, upper(c_name) as value from customer union all select 's' || s_suppkey::varchar, s_name from supplier")
def multiple_inputs(spark, d):
    """Two inputs, each with a mapper of its own."""
    customers = lambda df: df.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.upper("c_name").alias("value"))
    suppliers = lambda df: df.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_name").alias("value"))
    return readers.multiple_inputs((table(spark, d, "customer"), customers), (table(spark, d, "supplier"), suppliers))


@query(f"select token, count(*)::bigint as n from ({WORDS_SQL}) group by token")
def multi_file_word_count(spark, d):
    """Many text files, packed into few splits, counted as one input."""
    path = new_path(spark, "files")
    table(spark, d, "documents").where("text is not null").select("text").repartition(20).write.text(path)
    return project.token_counts(readers.packed_files(spark, [readers.output_files(spark, path)]), "value")


@query("select 0 as pool, count(*)::bigint as n from nation union all select 1, count(*) from region")
def packed_pools(spark, d):
    """Small files of two pools: no split holds both."""
    paths = [new_path(spark, "pool"), new_path(spark, "pool")]
    table(spark, d, "nation").select("n_name").repartition(5).write.text(paths[0])
    table(spark, d, "region").select("r_name").repartition(3).write.text(paths[1])
    return readers.packed_files(spark, [[p] for p in paths]).groupBy("pool").agg(F.count("*").alias("n"))


TERA = 3000
TERA_SQL = f"""select id, array_to_string(list_transform(range(10), lambda i: chr((('0x' || substr(md5(id::varchar), 2 * i + 1, 2))::int % 95 + 32)::int)), '') as key, lpad(id::varchar, 10, ' ') as row_id,
    substr(array_to_string(list_transform(range(8), lambda i: repeat(chr(((id * 8 + i) % 26 + 65)::int), 10)), ''), 1, 78) as filler from (select unnest(range({TERA})) as id)"""


@query(f"select row_number() over (order by key, row_id) as place, key, row_id, filler from ({TERA_SQL})")
def tera_sort(spark, d):
    """Generated 100-byte rows, written as lines, read by fixed width and sorted by their 10-byte keys."""
    path = new_path(spark, "tera")
    search.tera_rows(spark, TERA).select(F.concat("key", "row_id", "filler").alias("value")).write.text(path)
    rows = readers.fixed_width(spark, path).select("key", F.substring("value", 1, 10).alias("row_id"), F.substring("value", 11, 78).alias("filler"))
    return partition.global_index(rows, ["key", "row_id"]).withColumn("_i", F.col("_i").cast("long")).withColumnRenamed("_i", "place")


@query(f"select {TERA}::bigint as n, 0::bigint as misplaced")
def tera_validate(spark, d):
    """The sorted output as written, checked file by file and across files."""
    path = new_path(spark, "tera")
    sorting.total_sort(search.tera_rows(spark, TERA), "key").write.parquet(path)
    kept = spark.read.parquet(path)
    placed = kept.select("key", F.input_file_name().alias("part"), F.monotonically_increasing_id().alias("pos"))
    return kept.agg(F.count("*").alias("n")).withColumn("misplaced", sorting.validate_order(placed, "key", F.col("part"), F.col("pos")).agg(F.count("*").alias("m")).scalar())


@query("select count(*)::bigint as n, sum(i)::bigint as total from (select unnest(range(1000)) as i)")
def range_source(spark, d):
    return readers.row_range(spark, 1000, 7).agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@query("""with l as (select user_id, case event_type when 'click' then 'ins' when 'view' then 'upd' when 'error' then 'd' else event_type end as op from events)
    select op, count(*)::bigint as n, count(distinct doc)::bigint as docs from (select user_id::varchar as doc, unnest(case op when 'd' then ['delete'] when 'upd' then ['delete', 'insert'] else ['insert'] end) as op from l) group by op""")
def document_operation_lines(spark, d):
    """A log of document operations as lines of text: an update deletes and inserts, an unknown one inserts."""
    path = new_path(spark, "operations")
    op = F.when(F.col("event_type") == "click", "ins").when(F.col("event_type") == "view", "upd").when(F.col("event_type") == "error", "d").otherwise(F.col("event_type"))
    table(spark, d, "events").select(F.concat_ws(" ", F.col("user_id").cast("string"), op, F.lit("some text")).alias("value")).write.text(path)
    return readers.document_lines(spark, path).groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("docs"))


@query("select (i // 500)::varchar as split, count(*)::bigint as n, sum(i)::bigint as total from (select unnest(range(2000)) as i) group by 1")
def own_reader(spark, d):
    """A reader of one's own, a split a task, row by row."""
    rows = readers.python_source(spark, ["0", "1", "2", "3"], lambda s: ((s, i) for i in range(int(s) * 500, int(s) * 500 + 500)), "split string, i long")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("i").alias("total"))


@query("select (i - 1) // 100 as split, count(*)::bigint as n, min(c_custkey) as first_key from (select c_custkey, row_number() over (order by c_custkey) as i from customer) group by 1")
def n_line_splits(spark, d):
    return readers.n_line_splits(table(spark, d, "customer").select("c_custkey"), 100, ["c_custkey"]).groupBy("split").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))


@query("select case when o_orderstatus = 'F' then 'finished' else 'open' end as output, count(*)::bigint as n, sum(o_orderkey)::bigint as keys from orders group by 1")
def named_outputs(spark, d):
    """Two sinks of one job, read back."""
    paths = {name: new_path(spark, name) for name in ("finished", "open")}
    done = F.col("o_orderstatus") == "F"
    writers.write_named(table(spark, d, "orders"), {"finished": (paths["finished"], done), "open": (paths["open"], ~done)})
    parts = [spark.read.parquet(p).select(F.lit(n).alias("output"), "o_orderkey") for n, p in paths.items()]
    return parts[0].unionByName(parts[1]).groupBy("output").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("select true as refused")
def output_exists(spark, d):
    """A second job into the same folder is refused."""
    path = new_path(spark, "once")
    writers.write_pairs(table(spark, d, "region"), path, "r_regionkey", "r_name")
    try:
        writers.write_pairs(table(spark, d, "region"), path, "r_regionkey", "r_name")
        refused = False
    except Exception as e:  # Spark's own complaint; anything else is a fault
        refused = "ALREADY_EXISTS" in str(e).upper().replace(" ", "_")
    return spark.range(1).select(F.lit(refused).alias("refused"))


@query("select sum(case when try_cast(split_part(p_name, ' ', 2) as int) is null then 0 else 1 end)::bigint as good, sum(case when try_cast(split_part(p_name, ' ', 2) as int) is null then 1 else 0 end)::bigint as skipped from part")
def skipped_records(spark, d):
    """Rows that a mapper cannot take go to a side output."""
    path = new_path(spark, "skipped")
    good, bad = writers.split_bad(table(spark, d, "part"), F.split_part("p_name", F.lit(" "), F.lit(2)).try_cast("int").isNotNull())
    bad.write.parquet(path)
    return good.agg(F.count("*").alias("good")).withColumn("skipped", spark.read.parquet(path).agg(F.count("*").alias("n")).scalar())


@query("select row_number() over (order by s_name, r_name, n_name) as place, n_name from (select n_name, r_name, substr(n_name, 1, 1) as s_name from nation join region on n_regionkey = r_regionkey)")
def log_sort(spark, d):
    """Lines in lexical order of chosen columns."""
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = both.select(F.concat_ws("|", "n_name", "r_name", F.substring("n_name", 1, 1)).alias("line"))
    ordered = sorting.log_sort(lines, "line", [2, 1, 0], "|").select(F.split("line", r"\|")[0].alias("n_name"))
    return partition.numbered(ordered).select("n_name", F.col("_i").cast("long").alias("place"))


@query("select event_type || ' ' || strftime(ts, '%Y-%m-%d') as fields, count(*)::bigint as n, row_number() over (order by event_type || ' ' || strftime(ts, '%Y-%m-%d')) as place from events where user_id::varchar like '1%' group by 1")
def log_analyzer(spark, d):
    """Lines that hold a pattern, counted by two of their columns, in order."""
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), "event_type", F.concat(F.lit("user="), F.col("user_id").cast("string")))
    return indexing.analyze_logs(table(spark, d, "events").select(line.alias("line")), "line", "user=1", [1, 0]).withColumn("place", F.col("place").cast("long"))


@query("select 'jobs' as counter_group, 'lines' as counter, count(*)::bigint as n from nation")
def stream_counters(spark, d):
    """What a process counts on its error stream, summed over all processes."""
    lines = table(spark, d, "nation").select("n_name")
    return pipe.command_counters(pipe.command_output(lines, "n_name", ["awk", '{ print; print "reporter:counter:jobs,lines,1" > "/dev/stderr" }']))


@query("select upper(n_name) || '!' as name, n_nationkey * 2 as twice from nation where n_regionkey <> 0")
def chain_map(spark, d):
    steps = [lambda df: df.where("n_regionkey <> 0"), lambda df: df.withColumn("name", F.upper("n_name")), lambda df: df.select(F.concat("name", F.lit("!")).alias("name"), (F.col("n_nationkey") * 2).alias("twice"))]
    return project.chain(table(spark, d, "nation"), *steps)


@query("select n_nationkey as key, upper(n_name) as name from nation")
def native_map(spark, d):
    """A map on Arrow batches."""
    upper = lambda b: pa.RecordBatch.from_arrays([b.column(0), pc.utf8_upper(b.column(1))], names=["key", "name"])
    return pipe.arrow_map(table(spark, d, "nation").select("n_nationkey", "n_name"), upper, "key int, name string")


@query("select n_nationkey as key, length(n_name)::int as size from nation")
def threaded_map(spark, d):
    return pipe.threaded_map(table(spark, d, "nation").select("n_nationkey", "n_name"), lambda r: {"key": r["n_nationkey"], "size": len(r["n_name"])}, "key int, size int")


@query("select o_orderpriority, count(*)::bigint as n, max(o_totalprice) - min(o_totalprice) as spread from orders group by 1")
def user_aggregate(spark, d):
    """An aggregate of one's own: folds of batches, then of the folds."""
    fold = lambda t, lo, hi, n: t.group_by("o_orderpriority").aggregate([(lo, "min"), (hi, "max"), (n, "count" if lo == hi else "sum")])

    def partial(t):
        g = fold(t, "o_totalprice", "o_totalprice", "o_totalprice")
        return pa.table([g.column("o_orderpriority"), g.column("o_totalprice_min"), g.column("o_totalprice_max"), g.column("o_totalprice_count")], names=["o_orderpriority", "lo", "hi", "n"])

    def merge(t):
        g = fold(t, "lo", "hi", "n")
        return pa.table([g.column("o_orderpriority"), g.column("n_sum"), pc.subtract(g.column("hi_max"), g.column("lo_min"))], names=["o_orderpriority", "n", "spread"])

    orders = table(spark, d, "orders").select("o_orderpriority", "o_totalprice")
    return pipe.user_aggregate(orders, ["o_orderpriority"], partial, merge, "o_orderpriority string, n long, spread double", "o_orderpriority string, lo double, hi double, n long")


@query("select n_nationkey as key, i as at, n_name[i] as letter from (select n_nationkey, n_name, unnest(range(1, length(n_name) + 1)) as i from nation)")
def user_table(spark, d):
    """A table function of one's own: the letters of each name."""
    return pipe.user_table(table(spark, d, "nation"), ["n_nationkey", "n_name"], lambda k, name: ((k, i + 1, c) for i, c in enumerate(name)), "key int, at long, letter string")


@query("select n_regionkey as region, string_agg(n_name, '>' order by n_name) as names from nation group by 1")
def general_reducer(spark, d):
    """A reducer of one's own over the ordered rows of a key."""
    one = lambda t: pa.table({"region": pa.array([t.column("n_regionkey")[0].as_py()], pa.int32()), "names": pa.array([">".join(sorted(t.column("n_name").to_pylist()))])})
    return pipe.arrow_reduce(table(spark, d, "nation").select("n_regionkey", "n_name"), ["n_regionkey"], one, "region int, names string")


@query("""select 'LongValueSum' as kind, 'orders_' || o_orderstatus as id, count(*)::varchar as result from orders group by o_orderstatus
    union all select 'LongValueMax', 'customer', max(o_custkey)::varchar from orders union all select 'UniqValueCount', 'customers', count(distinct o_custkey)::varchar from orders""")
def user_described_aggregates(spark, d):
    """Two descriptors of one's own over one pass."""
    first = lambda df: F.array(G.emit(G.LONG_SUM, F.concat(F.lit("orders_"), df["o_orderstatus"]), F.lit(1)))
    second = lambda df: F.array(G.emit(G.LONG_MAX, "customer", df["o_custkey"]), G.emit(G.UNIQUE_COUNT, "customers", df["o_custkey"]))
    return G.described_aggregates(table(spark, d, "orders"), first, second, kinds={G.LONG_SUM, G.LONG_MAX, G.UNIQUE_COUNT})


@query("""with v as (select o_orderstatus, sum(9223372036854775807::hugeint - o_orderkey) as s from orders group by 1) select 'LongValueSum' as kind, o_orderstatus as id, (case when (s % 18446744073709551616) >= 9223372036854775808 then (s % 18446744073709551616) - 18446744073709551616 else s % 18446744073709551616 end)::varchar as result from v""")
def wrapping_sum(spark, d):
    """Sums of longs wrap around as two's complement does."""
    orders = table(spark, d, "orders")
    return G.dynamic_aggregates(orders, F.array(G.emit(G.LONG_SUM, F.col("o_orderstatus"), F.lit((1 << 63) - 1) - F.col("o_orderkey"))), kinds={G.LONG_SUM})


@query("select count(*)::bigint as n, sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint as finished from orders")
def job_counters(spark, d):
    """Counters beside a job's output, read after it has run."""
    orders, seen = G.counters(table(spark, d, "orders"), "job", n=F.count("*"), finished=F.count(F.when(F.col("o_orderstatus") == "F", 1)))
    writers.discard(orders)
    return spark.range(1).select(*[F.lit(seen.get[c]).cast("long").alias(c) for c in ("n", "finished")])


@query("select count(distinct o_custkey)::bigint as n_keys, 0::bigint as n_split from orders")
def hash_partition(spark, d):
    """Rows of a key share a partition."""
    dealt = partition.hash_partition(table(spark, d, "orders").select("o_custkey"), 5, "o_custkey").select("o_custkey", F.spark_partition_id().alias("p"))
    per = dealt.groupBy("o_custkey").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    return per.agg(F.count("*").alias("n_keys"), F.count(F.when(F.col("lo") < F.col("hi"), 1)).alias("n_split"))


@query("select n_nationkey as key, n_name, r_name, count(c_custkey)::bigint as customers from nation join region on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by all")
def many_join(spark, d):
    """One join over three inputs, named as on a command line."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    a, b = nation.select(F.col("n_nationkey").alias("k"), "n_name"), nation.select(F.col("n_nationkey").alias("k"), "r_name")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return joins.many_join("inner", "k", a, b, c).select("key", "s0.n_name", "s1.r_name", "s2.customers")


@query("""select c_custkey, c_custkey * 1024 as kilo, sqrt((c_acctbal - 1) * (c_acctbal - 1) + c_nationkey * c_nationkey) as far, c_nationkey::bigint as number,
    regexp_replace(printf('%.2f', floor(v * 100 / unit + 0.5) / 100), '\\.?0+$', '') || name as size from (select *, case when v < 1048576 then 1024.0 when v < 1073741824 then 1048576.0 else 1073741824.0 end as unit,
    case when v < 1048576 then ' KB' when v < 1073741824 then ' MB' else ' GB' end as name from (select *, c_custkey * 1000 as v from customer))""")
def number_functions(spark, d):
    """Numbers from text with a binary prefix, distances, sizes in words."""
    c = table(spark, d, "customer")
    text = F.concat(F.col("c_custkey").cast("string"), F.lit("k"))
    far = strings.distance([F.col("c_acctbal"), F.col("c_nationkey")], [F.lit(1.0), F.lit(0)])
    return c.select("c_custkey", strings.binary_prefix_to_long(text).alias("kilo"), far.alias("far"), strings.number_of(F.concat(F.lit(" "), F.col("c_nationkey").cast("string"))).alias("number"), strings.byte_description(F.col("c_custkey") * 1000).alias("size"))


@query("select '<name>' || n_name || '</name>' as key, '' as value from nation")
def marked_file_records(spark, d):
    """Records between marks in files that hold several on a line."""
    path = new_path(spark, "marked")
    lines = table(spark, d, "nation").select(F.concat(F.lit("<row><name>"), "n_name", F.lit("</name><x>1</x></row>")).alias("value"))
    lines.write.text(path)
    return readers.marked_records(readers.whole_files(spark, path), "value", "<name>", "</name>")


@query("select n_nationkey as number, n_name as name from nation")
def typed_json_records(spark, d):
    lines = table(spark, d, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("number"), F.col("n_name").alias("name"))).alias("line"))
    return readers.typed_records(lines, "line", "number int, name string", "json")


@query("select n_nationkey as number, n_name as name from nation")
def typed_xml_records(spark, d):
    line = F.concat(F.lit("<row><number>"), F.col("n_nationkey").cast("string"), F.lit("</number><name>"), "n_name", F.lit("</name></row>"))
    return readers.typed_records(table(spark, d, "nation").select(line.alias("line")), "line", "number int, name string", "xml")


BOARD = "5 3 ? ? 7 ? ? ? ?\n6 ? ? 1 9 5 ? ? ?\n? 9 8 ? ? ? ? 6 ?\n8 ? ? ? 6 ? ? ? 3\n4 ? ? 8 ? 3 ? ? 1\n7 ? ? ? 2 ? ? ? 6\n? 6 ? ? ? ? 2 8 ?\n? ? ? 4 1 9 ? ? 5\n? ? ? ? 8 ? ? 7 9"
_CELLS = BOARD.replace(" ", "").replace("\n", "")


@query(f"""with recursive x(s, place) as (select '{_CELLS}', {_CELLS.index("?") + 1} union all select t, instr(t, '?') from (select substr(s, 1, place - 1) || z || substr(s, place + 1) as t from x, (select unnest(range(1, 10))::varchar as z) as digits where place > 0 and
    len(list_filter(range(9), lambda k: z = substr(s, (place - 1) // 9 * 9 + k + 1, 1) or z = substr(s, (place - 1) % 9 + k * 9 + 1, 1) or z = substr(s, (place - 1) // 3 % 3 * 3 + (place - 1) // 27 * 27 + k + k // 3 * 6 + 1, 1))) = 0))
    select replace('{BOARD.replace(chr(10), "/")}', '/', chr(10)) as board, array_to_string(list_transform(range(9), lambda r: array_to_string(list_transform(range(9), lambda c: substr(s, r * 9 + c + 1, 1)), ' ')), chr(10)) as solution from x where place = 0""")
def sudoku(spark, d):
    return search.solve_sudokus(spark.createDataFrame([(BOARD,)], "board string"), "board")


_PLACED = search.placement_masks(6, 10, "".join(search.PENTOMINOES))


@query(f"""with recursive p(first, cells, piece, name) as (values {", ".join(f"({a}, {b}, {c}, '{name}')" for a, b, c, name in _PLACED)}),
    b(filled, used, solution, n) as (select 0::bigint, 0::bigint, '', 0 union all select b.filled | p.cells, b.used | p.piece, case when n = 0 then name else solution || '; ' || name end, n + 1
    from b join p on p.first = ((-1 - b.filled) & (b.filled + 1)) where b.filled & p.cells = 0 and b.used & p.piece = 0) select solution from b where n = 12""")
def pentomino(spark, d):
    """All tilings of the 6 x 10 board with the twelve pieces."""
    return search.pentomino_tilings(spark, 6, 10)

