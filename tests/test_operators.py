"""Golden cases of the operators, by value. Inputs and expected results marked as fixed values are those of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from kvflow.functions import strings
from kvflow.operators import aggregates as G
from kvflow.operators import filters, indexing, joins, keyspec, kmeans, linalg, partition, project, search, sorting
from kvflow.plans import pipe
from kvflow.sources import readers, writers
from kvflow.streaming import events


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_field_selection(spark):
    # FIXTURES.md F1, a line and two field specs.
    f = [f"{i:04d}" for i in range(7)]
    got = project.field_select(lines(spark, "-".join(f)), "value", "6,5,1-3:0-", ":4,3,2,1,0,0-").first()
    want = [f[3], f[2], f[1], f[5], f[6], f[6], f[5], f[1], f[2], f[3], *f]
    assert got.key is None and got.value == "-".join(want)


# FIXTURES.md F2, two lines and which of them comes first.
LINE1 = "123 -123 005120 123.9 0.01 0.18 010 10.0 4444.1 011 011 234"
LINE2 = "134 -12 005100 123.10 -1.01 0.19 02 10.1 4444"
SPECS = [("-k1,1n", 1), ("-k2,2n", 1), ("-k2.2,2n", 2), ("-k3.4,3n", 2), ("-k3.2,3.3n -k4,4n", 2), ("-k3.2,3.3n -k4,4nr", 1), ("-k2.4,2.4n", 2), ("-k7,7", 1), ("-k7,7n", 2), ("-k8,8n", 1), ("-k9,9", 2), ("-k11,11", 2), ("-k10,10", 2)]


@pytest.mark.parametrize("spec,first", SPECS)
def test_key_spec(spark, spec, first):
    got = keyspec.sort_by_spec(lines(spark, LINE1, LINE2), "value", spec, " ").first().value
    assert got == (LINE1 if first == 1 else LINE2)


def test_dynamic_aggregates(spark):
    words = [(f"{i:02d}",) for i in range(1, 20) for _ in range(i)]
    w, number = F.col("w"), F.col("w").cast("int").cast("string")
    entries = F.array(G.emit(G.LONG_SUM, F.concat(F.lit("count_"), w), F.lit(1)), G.emit(G.LONG_MAX, "max", w), G.emit(G.LONG_MIN, "min", w), G.emit(G.STRING_MAX, "smax", number), G.emit(G.STRING_MIN, "smin", number), G.emit(G.UNIQUE_COUNT, "uniq", w), G.emit(G.HISTOGRAM, "hist", w))
    got = {r.id: r.result for r in G.dynamic_aggregates(spark.createDataFrame(words, "w string"), entries, 14).collect()}
    assert [got[k] for k in ("max", "min", "smax", "smin", "uniq", "count_07")] == ["19", "1", "9", "1", "15", "7"]
    n, low, mid, high, mean, sd = got["hist"].split("\t")
    assert (n, low, mid, high, float(mean)) == ("19", "1", "10", "19", 10.0) and abs(float(sd) - 30**0.5) < 1e-9


def test_text_aggregates(spark):
    got = G.text_aggregates(lines(spark, "LongValueSum:are\t1", "LongValueSum:are\t2", "LongValueMax:m:x\t7", "LongValueSum:bad\tq"), "value")
    assert {(r.id, r.result) for r in got.collect()} == {("are", "3"), ("m:x", "7"), ("bad", None)}


def sources(spark):
    rows = [[((4 * k) if k % 4 == 0 else 4 * k + i, 10 * k + i) for k in range(8) for _ in range(2 if k == i else 1)] for i in range(4)]
    return [spark.createDataFrame(r, "key int, val int") for r in rows]


def test_joins(spark):
    s = sources(spark)
    one = joins.inner("key", **{f"s{i}": d for i, d in enumerate(s)}).collect()
    assert sorted(r.key for r in one) == [0, 0, 16]
    every = joins.outer("key", **{f"s{i}": d for i, d in enumerate(s)}).collect()
    assert all(sum(r[f"s{i}"] is not None for i in range(4)) == (4 if r.key % 16 == 0 else 1) for r in every)
    last = joins.override("key", *s).collect()
    assert {r.val for r in last if r.key % 16 == 0} == {3, 43} and all(r.src == 3 for r in last if r.key % 16 == 0)
    expr = joins.JoinExpression("key", {"a": s[0], "b": s[1], "e": s[0].limit(0)}, {"only": lambda f: list(f.values())[0] & ~list(f.values())[1]})
    assert expr.run("outer(inner(tbl(a),tbl(b)),tbl(e))").count() == joins.inner("key", a=s[0], b=s[1]).count()
    assert {r.key for r in joins.JoinExpression("key", expr.sources, expr.define).run("only(tbl(a),tbl(b))").collect()} == {4 * k for k in range(8) if k % 4}
    with pytest.raises(ValueError):
        joins.JoinExpression("key", {"a": s[0]}).run("what(tbl(a))")


def test_tagged_join(spark):
    # FIXTURES.md F6, two tagged tables and their join.
    a = spark.createDataFrame([("A.a11", "A.a12"), ("A.a21", "A.a22"), ("B.a21", "A.a32"), ("A.a31", "A.a32"), ("B.a31", "A.a32"), (None, "x")], "k string, v string")
    b = spark.createDataFrame([("A.a11", "B.a12"), ("A.a11", "B.a13"), ("B.a11", "B.a12"), ("B.a21", "B.a22"), ("A.a31", "B.a32"), ("B.a31", "B.a32"), (None, "y")], "k string, v string")
    both = lambda l, r: F.when(l.isNotNull() & r.isNotNull(), F.concat_ws("\t", "key", l["v"], r["v"]))
    got = sorted(r.value for r in joins.tagged_join(a, b, "k", both).collect())
    assert got == ["A.a11\tA.a12\tB.a12", "A.a11\tA.a12\tB.a13", "A.a31\tA.a32\tB.a32", "B.a21\tA.a32\tB.a22", "B.a31\tA.a32\tB.a32"]
    assert joins.tagged_join(a, b, "k", both, 1, (["v"], ["v"])).count() == 4


def test_range_partition(spark):
    # FIXTURES.md F7, cut points and the range of each key.
    cuts = ["aabbb", "babbb", "daddd", "dddee", "ddhee", "dingo", "hijjj", "n", "yak"]
    want = {"aaaaa": 0, "aaabb": 0, "aabbb": 1, "babbb": 2, "baabb": 1, "yai": 8, "yak": 9, "z": 9, "ddngo": 5, "hi": 6}
    got = lines(spark, *want).select("value", partition.range_of(F.col("value"), cuts).alias("p")).collect()
    assert {r.value: r.p for r in got} == want
    assert lines(spark, "n").select(partition.range_left_of(F.col("value"), cuts)).first()[0] == 7


def test_samplers(spark):
    n = spark.range(1, 1001).repartition(7)
    assert sorted(r.id for r in partition.interval_sample(n, 1, 4, ["id"]).collect())[:3] == [1, 5, 9]
    assert filters.every_nth(n, ["id"], 100).count() == 10
    assert partition.keep_percent(n, 250, ["id"]).count() == 2500
    assert [r._i for r in partition.global_index(n, ["id"]).orderBy("id").collect()] == list(range(1, 1001))
    tied = n.select(F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("k"), "id")
    got = partition.global_index(tied, ["k", "id"], ranges=5).collect()
    key = lambda r: (r.k is not None, r.k or 0, r.id)  # noqa: E731  nulls first
    assert [r._i for r in sorted(got, key=key)] == list(range(1, 1001))
    assert partition.global_index(n.where("id < 0"), ["id"]).count() == 0
    assert partition.split_points([1, 1, 1, 1, 2, 3, 4, 5], 4) == [1, 2, 4]
    assert readers.n_line_splits(n, 10, ["id"]).groupBy("split").count().where("count <> 10").count() == 0


def test_order_validation(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 2, 3), (0, 3, 2), (1, 1, 2), (1, 2, 9)], "part int, pos int, key int")
    got = {(r.kind, r.part) for r in sorting.validate_order(df, "key", F.col("part"), F.col("pos")).collect()}
    assert got == {("misorder", 0)}
    both = sorting.validate_order(spark.createDataFrame([(0, 1, 1), (0, 2, 5), (0, 3, 4), (1, 1, 2), (1, 2, 9)], "part int, pos int, key int"), "key", F.col("part"), F.col("pos"))
    assert sorted(r.kind for r in both.collect()) == ["bad split", "misorder"]
    worse = df.where("pos <> 3")
    assert {(r.kind, r.part) for r in sorting.validate_order(worse, "key", F.col("part"), F.col("pos")).collect()} == {("bad split", 1)}


def test_kmeans_lines(spark):
    got = {r.cluster: r.x for r in kmeans.kmeans_lines(lines(spark, "2 3 1 4 2 3 5"), "value", 1).collect()}
    assert got == {0: 2.5, 1: 5.0}
    two = kmeans.kmeans_lines(lines(spark, "2 2 0 0 50 50 1.5 2.5 60.9 61.2"), "value", 2).orderBy("cluster").collect()
    assert [(r.x, r.y) for r in two] == [(1, 2), (60, 61)]
    empty = kmeans.kmeans_lines(lines(spark, "2 1 0 100 1"), "value", 1).orderBy("cluster").collect()
    assert [r.x for r in empty] == [1.0, None]


def test_matrices(spark):
    assert linalg.matmul_lines(lines(spark, "0 1 1 2 3 4 5 6"), "value").first().v == 32.0
    cells = {(r.row, r.col): r.v for r in linalg.block_matmul_lines(lines(spark, "0 0 0 2 2 1 2 3 4 5 6 7 8"), "value").collect()}
    assert cells == {(0, 0): 19.0, (0, 1): 22.0, (1, 0): 43.0, (1, 1): 50.0}


def test_strings(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    for text in ("a,b\\c", "a\x00b\x01,c", ",,\\\\,", ""):
        assert one(strings.unescape(strings.escape(F.lit(text)))) == text
    assert one(strings.unescape(F.lit("a\x00b\\,"))) == "a\x00b," and one(strings.split_escaped(F.lit("a\x01b,c"))) == ["a\x01b", "c"]
    assert one(strings.split_escaped(F.lit("a\\\\,b\\,\\"))) == ["a\\\\", "b\\,\\"] and one(strings.split_escaped(F.lit(",,a,,"))) == ["", "", "a"] and one(strings.split_escaped(F.lit(""))) == []
    assert [one(strings.byte_description(F.lit(n))) for n in (512, 1500, 2 << 20, 3 << 30)] == ["0.5 KB", "1.46 KB", "2 MB", "3 GB"]
    assert [one(strings.format_time(F.lit(a), F.lit(b))) for a, b in ((1_000, 0), (61_000, 1_000), (0, 5))] == ["1970-01-01 00:00:01", "1970-01-01 00:01:01 (1mins, 0sec)", ""]
    assert one(strings.number_of(F.lit(" 12 "))) == 12 and one(strings.number_of(F.lit("x"))) is None
    assert one(strings.split_escaped(F.lit("a\\,b,c,,"))) == ["a\\,b", "c"]
    assert one(strings.split_string(F.lit("a, b,,c"), ", ")) == ["a", "b", "c"]
    assert [one(strings.binary_prefix_to_long(F.lit(t))) for t in ("1k", "-2m", "7", "x", "1g")] == [1024, -(2 << 20), 7, None, 1 << 30]
    assert one(strings.time_difference(F.lit(3_723_000))) == "1hrs, 2mins, 3sec"
    assert one(strings.human_readable(F.lit(1536))) == "1.5k"
    assert one(strings.find(F.lit("äbc"), "b")) == 2 and one(strings.find(F.lit("abc"), "z")) == -1
    assert abs(one(strings.distance([F.lit(0.0), F.lit(0.0)], [F.lit(3.0), F.lit(4.0)])) - 5) < 1e-12


def test_key_value_rules(spark):
    k, v = project.split_first(F.col("value"))
    got = [(r.k, r.v) for r in lines(spark, "\tx", "alone", "a\tb\tc").select(k.alias("k"), v.alias("v")).collect()]
    assert got == [("", "x"), ("alone", ""), ("a", "b\tc")]
    pairs = spark.createDataFrame([("a", "b"), (None, "b"), ("a", None), (None, None)], "key string, value string")
    assert [r[0] for r in pairs.select(writers.pair_text(F.col("key"), F.col("value"))).collect()] == ["a\tb", "b", "a", None]


def test_files(spark, tmp_path):
    pairs = spark.createDataFrame([("b", "2"), ("a", "1"), ("c", "3")], "key string, value string")
    writers.write_pairs(pairs, f"{tmp_path}/kv", codec="gzip")
    assert sorted(map(tuple, readers.key_value_lines(spark, f"{tmp_path}/kv").collect())) == [("a", "1"), ("b", "2"), ("c", "3")]
    with pytest.raises(Exception, match="already exists|EXISTS"):
        writers.write_pairs(pairs, f"{tmp_path}/kv")
    writers.write_sequence_file(pairs, f"{tmp_path}/seq")
    assert sorted(map(tuple, readers.sequence_file(spark, f"{tmp_path}/seq").collect())) == [("a", "1"), ("b", "2"), ("c", "3")]
    writers.write_map(pairs, f"{tmp_path}/map", "key")
    kept = spark.read.parquet(f"{tmp_path}/map")
    assert readers.map_get(kept, "key", "b").first().value == "2"
    assert readers.map_closest(kept, "key", "bb").first().key == "c" and readers.map_closest(kept, "key", "bb", True).first().key == "b"
    assert readers.map_middle(kept, "key").first().mid_key == "b"
    writers.write_by(pairs, f"{tmp_path}/by", F.col("key"))
    assert {r.leaf for r in spark.read.parquet(f"{tmp_path}/by").collect()} == {"a", "b", "c"}
    writers.write_named(pairs, {"one": (f"{tmp_path}/one", F.col("value") == "1"), "rest": (f"{tmp_path}/rest", F.col("value") != "1")})
    assert spark.read.parquet(f"{tmp_path}/one").count() == 1 and spark.read.parquet(f"{tmp_path}/rest").count() == 2
    writers.discard(pairs)
    marked = readers.marked_records(lines(spark, "<P><x>one\n</x> no <x>two</x></P>"), "value", "<x>", "</x>")
    assert [r.key for r in marked.collect()] == ["<x>one\n</x>", "<x>two</x>"]
    tricky = "<![CDATA[<x>no</x>]]><x>a<![CDATA[</x>]]>b</x>"
    assert [r.key for r in readers.marked_records(lines(spark, tricky), "value", "<x>", "</x>", slow_match=True).collect()] == ["<x>a<![CDATA[</x>]]>b</x>"]
    good, bad = writers.split_bad(lines(spark, "1", "x"), F.col("value").try_cast("int").isNotNull())
    assert good.count() == bad.count() == 1
    typed = readers.typed_records(lines(spark, "1,a", "2,b"), "value", "n int, s string")
    assert [tuple(r) for r in readers.evolved(typed, "s string, more long").collect()] == [("a", None), ("b", None)]
    own = readers.python_source(spark, ["1", "2"], lambda s: iter([(int(s), s)]), "n int, s string")
    assert sorted(r.n for r in own.collect()) == [1, 2]
    ops = project.document_operations(lines(spark, "0 ins a b", "1 upd c", "2 del", "3 what d"), "value").collect()
    assert [(r.doc, r.op) for r in ops] == [("0", "insert"), ("1", "delete"), ("1", "insert"), ("2", "delete"), ("3", "insert")]


def test_subprocesses(spark):
    text = lines(spark, "roses.are.red", "violets.are.blue", "bunnies.are.pink")
    mapped = pipe.map_command(text, "value", ["tr", ".", "\n"])
    reduced = pipe.reduce_command(mapped.select("key", F.lit("").alias("value")), "uniq -c")
    assert sum(r.key.strip().split()[1] == "are" for r in reduced.collect()) == 1
    assert pipe.map_command(lines(spark, "a.b.c"), "value", "cat", 2, ".").first() == ("a.b", "c")
    with pytest.raises(Exception, match="ended with"):
        pipe.map_command(text, "value", "false").collect()
    assert pipe.split_work(10, 4, 1, 4.0) == (5, 5) or pipe.split_work(10, 4, 1, 4.0)[0] + pipe.split_work(10, 4, 1, 4.0)[1] == 10


def test_job_graph():
    g = pipe.JobGraph()
    g.add("a", lambda: 1)
    g.add("b", lambda: 1 / 0, "a")
    g.add("c", lambda: 2, "b")
    assert g.run() == {"a": "success", "b": "failed", "c": "dependent failed"}


def test_search_and_index(spark):
    assert abs(search.pi_estimate(spark, 20_000).first().pi - 3.1428) < 1e-9
    assert search.tera_rows(spark, 5).where("length(key) = 10 and length(row_id) = 10 and length(filler) = 78").count() == 5
    assert search.random_text(spark, 20, ["a", "b"], 2, 4, 1).where("size(split(value, ' ')) between 2 and 4").count() == 20
    log = indexing.parse_logs(lines(spark, "2024-01-02 03:04:05,678 WARN a.B: from 10.0.0.1 x", "junk"), "value", anonymise=True).collect()
    assert (log[0].level, log[0].message) == ("WARN", "from <ip> x") and log[1].message == "junk"
    sums = [G.shuffle_checksum(df, "id").first() for df in (spark.range(100), spark.range(100).repartition(9))]
    assert sums[0] == sums[1]
    stats = spark.createDataFrame([(9, 3, 4, 2, 5, 10)], "spilled int, map_output int, launched int, completed int, side_bytes int, input_bytes int")
    assert tuple(indexing.ratio_rules(stats).first())[-3:] == (1.0, 1.0, 0.5)


def test_stream(spark, tmp_path):
    batch = spark.createDataFrame([("2024-01-01 01:00:00", "a"), ("2024-01-01 02:00:00", "a"), ("2024-01-05 00:00:00", "b")], "ts string, k string").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(f"{tmp_path}/in")
    stream = events.windowed_counts(events.stream_table(spark, f"{tmp_path}/in", batch.schema), "k", late="1 day")
    events.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert {(r.k, r.n) for r in events.windowed_counts(batch, "k").collect()} == {("a", 2), ("b", 1)}
    assert {(r.k, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()} <= {("a", 2), ("b", 1)}


def test_counters(spark):
    df, seen = G.counters(spark.range(10), "c", rows=F.count("*"), even=F.count(F.when(F.col("id") % 2 == 0, 1)))
    df.count()
    assert seen.get == {"rows": 10, "even": 5}


def test_bloom_filters(spark):
    keys = spark.createDataFrame([(i % 50,) for i in range(120)] + [(None,)], "k int")
    counted = filters.counting_filter(keys, "k", 4096)
    about = {r.key: r.n for r in filters.approximate_counts(spark.range(100).select(F.col("id").cast("int").alias("k")), "k", counted, 4096).collect()}
    assert all(about[k] >= (3 if k < 20 else 2) for k in range(50)) and sum(about[k] > 0 for k in range(50, 100)) < 5
    fewer = filters.filter_without(counted, keys.where("k < 25"), "k", 4096)
    assert all(r.n >= 2 for r in filters.approximate_counts(keys.where("k >= 25"), "k", fewer, 4096).collect())
    assert filters.approximate_counts(keys.where("k < 25"), "k", fewer, 4096).where("n > 0").count() < 5
    kept = filters.dynamic_semi_join(spark.range(1000).select(F.col("id").cast("int").alias("k")), "k", filters.dynamic_filter(keys, "k", 4, 4096), 4, 4096)
    assert {r.k for r in kept.collect()} >= set(range(50)) and kept.count() < 60
    wrong = spark.createDataFrame([(7,), (9,)], "k int")
    for scheme in ("fewest_lost", "most_cleared", "ratio", "random"):
        less = filters.retouched_filter(counted, wrong, "k", 4096, scheme=scheme)
        assert filters.approximate_counts(wrong, "k", less, 4096).where("n > 0").count() == 0
    # hashes near the ends of the range of a long must not overflow; the bitmap is as SQL's own bits say
    assert filters.bloom_filter(spark.range(200_000), "id", 64).first().words == [-1]
    bits = {r.bit for r in keys.where("k is not null").select(F.explode(filters.bloom_bits(F.col("k"), 4096, 4)).alias("bit")).collect()}
    words = filters.bloom_filter(keys, "k", 4096).first().words
    assert {64 * i + b for i, w in enumerate(words) for b in range(64) if w >> b & 1} == bits and len(words) == 64
    asked = spark.range(3000).select(F.col("id").cast("int").alias("k")).unionByName(keys.where("k is null"))
    kept = {r.k for r in filters.bloom_semi_join(asked, "k", keys, "k").collect()}
    assert kept >= set(range(50)) and None not in kept and len(kept) < 200
    plan = filters.bloom_semi_join(asked, "k", keys, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert {r.k for r in filters.bloom_semi_join(asked, "k", keys, "k", most_bits=64).collect()} == set(range(50))


def test_dynamic_filter_grows_with_its_keys(spark, tmp_path):
    from kvflow.plans.queries import QUERIES

    assert filters.slices_for(spark.range(0), "id") == filters.slices_for(spark.range(6000), "id") == 1
    # the even customers of 300,000 have orders: a fixed number of slices has less than four bits for each
    spark.range(300_000).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(150_000).select((2 * F.col("id")).alias("o_custkey"), F.lit("P").alias("o_orderstatus")).write.parquet(f"{tmp_path}/orders.parquet")
    assert tuple(QUERIES["dynamic_bloom_membership"](spark, str(tmp_path)).first()) == (150_000, 0, True)


def test_sums_wrap(spark):
    rows = spark.createDataFrame([((1 << 63) - 1,), (1,), (5,), (None,)], "v long")
    got = G.dynamic_aggregates(rows, F.array(G.emit(G.LONG_SUM, "s", F.col("v"))), kinds={G.LONG_SUM}).collect()
    assert [r.result for r in got] == [str(-(1 << 63) + 5)]


def test_aggregates_read_once(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id % 7 as string) s").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    every = F.array(G.emit(G.LONG_SUM, "a", F.col("id")), G.emit(G.STRING_MAX, "b", F.col("s")), G.emit(G.UNIQUE_COUNT, "c", F.col("s")), G.emit(G.HISTOGRAM, "d", F.col("s")))
    out = G.dynamic_aggregates(df, every)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
    once = G.dynamic_aggregates(df, every, kinds={G.LONG_SUM, G.UNIQUE_COUNT, G.HISTOGRAM})
    assert once._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert {(r.id, r.result.split("\t")[0]) for r in out.collect()} == {("a", "4950"), ("b", "6"), ("c", "7"), ("d", "7")}


def test_numbers_within_groups(spark):
    rows = spark.range(300).select((F.col("id") % 3).alias("g"), "id").withColumn("g", F.when(F.col("g") < 2, F.col("g")))
    got = partition.global_index(rows, ["id"], within=["g"]).collect()
    for g in (0, 1, None):
        mine = sorted((r.id, r._i) for r in got if r.g == g)
        assert [i for _, i in mine] == list(range(1, 101))
    run = partition.running_total(rows, ["id"], "id").collect()
    assert [r._run for r in sorted(run, key=lambda r: r.id)] == [n * (n + 1) // 2 for n in range(300)]


def test_every_nth_of_a_reader(spark):
    assert filters.every_nth_of_reader(spark.range(0, 100, 1, 4), 10).count() == 12
    assert "Exchange" not in filters.every_nth_of_reader(spark.range(0, 100, 1, 4), 10)._jdf.queryExecution().executedPlan().toString()


def test_kmeans_settles(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal((0, 0), 3, (80, 2)), rng.normal((30, 5), 4, (80, 2)), rng.normal((10, 40), 2, (80, 2))])
    now = start = np.array([(1.0, 1.0), (5.0, 5.0), (9.0, 9.0)])
    for _ in range(100):
        at = ((points[:, None] - now[None]) ** 2).sum(2).argmin(1)
        new = np.array([points[at == k].mean(0) for k in range(3)])
        moved, now = np.hypot(*(new - now).T).max(), new
        if moved <= 1.0:
            break
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double")
    got = kmeans.kmeans(df, ["x", "y"], [tuple(c) for c in start]).orderBy("cluster").collect()
    assert np.allclose([(r.x, r.y) for r in got], now)


def test_database(spark, tmp_path):
    """A table written to and read from a database, with conditions, fields and a parallel read."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(100).select(F.col("id").alias("k"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    writers.write_jdbc(rows, url, "pages", **options)
    writers.write_jdbc(rows.where("k < 5"), url, "pages", ["k", "name"], **options)
    assert readers.jdbc_table(spark, url, "pages", **options).count() == 105
    some = readers.jdbc_table(spark, url, "pages", ["name"], "k >= 95", ("k", 0, 100, 4), **options)
    assert some.columns == ["name"] and sorted(r[0] for r in some.collect()) == [f"n{i}" for i in range(95, 100)] and some.rdd.getNumPartitions() == 4
    assert readers.jdbc_query(spark, url, "select count(*) as n from pages", **options).first()[0] == 105


def test_store(spark, tmp_path):
    import os

    from kvflow.plans import store

    kept = [store.written(spark.range(3), f"t{i}") for i in range(2)]
    folders = [df._kvflow_path.removeprefix("file:").replace("//", "/") for df in kept]
    assert all(map(os.path.isdir, folders)) and store.shared_dir(spark) in kept[0]._kvflow_path
    store.drop(kept[0])
    assert [os.path.isdir(f) for f in folders] == [False, True]
    store.release(spark)
    assert not os.path.isdir(folders[1])
    assert "/tmp/kvflow-" not in store.shared_dir(spark.newSession())


def test_output_files(spark, tmp_path):
    spark.range(3).selectExpr("cast(id as string) value").coalesce(1).write.text(f"{tmp_path}/o")
    (tmp_path / "o" / "_logs").mkdir()
    found = readers.output_files(spark, f"{tmp_path}/o")
    assert len(found) == 1 and found[0].endswith(".txt")


def test_key_match_is_whole(spark):
    got = lines(spark, "ab", "ab\n", "xab", "abx").where(filters.key_matches(F.col("value"), "ab|zz")).collect()
    assert [r.value for r in got] == ["ab"]


def test_map_lookups(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("key"), F.col("id").cast("string").alias("value"))
    writers.write_hashed_map(rows, f"{tmp_path}/hashed", "key", 4)
    assert readers.hashed_map_get(spark, f"{tmp_path}/hashed", "key", 42, 4).collect() == [(42, "42")]
    assert readers.hashed_map_get(spark, f"{tmp_path}/hashed", "key", 420, 4).count() == 0
    assert [readers.map_range(rows, "key", *b).count() for b in ((10, 20), (None, 20), (90, None), (None, None))] == [10, 20, 10, 100]


def test_replicated_and_many_joins(spark):
    a, b = spark.range(10).withColumnRenamed("id", "k"), spark.range(5, 15).withColumnRenamed("id", "k")
    for most in (100, 3):
        joined = joins.replicated_join(a, b, "k", most_rows=most)
        assert {r.k for r in joined.collect()} == set(range(5, 10))
        assert ("BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()) == (most == 100)
    v = a.withColumn("v", F.col("k")), b.withColumn("v", -F.col("k"))
    assert [joins.many_join(op, "k", *v).count() for op in ("inner", "outer", "override")] == [5, 15, 15]


def test_text_positions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(strings.char_at(F.lit("aé𝄞"), i)) for i in (0, 1, 3, 7, -1)] == [97, 233, 0x1D11E, -1, -1]
    assert one(strings.valid_utf8(F.lit(b"\xc3\xa9"))) and not one(strings.valid_utf8(F.lit(b"\xc3")))


def test_index_segments(spark):
    docs = spark.createDataFrame([(i, "all") for i in range(25)], "id int, text string")
    got = indexing.inverted_index(docs, "id", "text", segment_docs=10).collect()
    assert sorted((r.segment, r.n_docs) for r in got) == [(0, 10), (1, 10), (2, 5)]
