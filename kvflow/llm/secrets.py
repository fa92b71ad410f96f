"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Every text is matched once per kind of secret; spans follow from the lengths of the matches and of the pieces between
them, so no position function is needed. Base kinds: ``assign`` (a named credential and its value), ``access`` (an
access key id) and ``hex`` (a long hexadecimal run). The method adds ``live`` spans: key-like strings (at least
``min_key`` of key characters with lower case, upper case and digits) that no base span covers. Candidate values are
hashed and counted over the corpus by distinct texts (copies of one text count once) and distinct sources (owners): a
value of more than ``max_owners`` owners, or of several owners in more than ``max_documents`` texts, is a published
example, any other is owner-specific and looks live, however often its one owner repeats it. Base spans are reported
either way, with their class; a key-like string is only reported if live. Runs of any length are told alike. Values and
texts are told apart by 64-bit hashes.

Defined cases: null text is empty; a null source counts as one source; repeated rows are each reported and count as
one document, as do copies under other ids; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._names import own, unused
from ._store import drop, written

#: The patterns of the base kinds (value group, least characters of it).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Whether a text can hold one at all: cheap to refuse.
ASSIGN_HINT = r"""(?i)(?:passw|secret|token|api_?key)[a-z]*["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "live")
#: What an expression's state holds is copied with every step, so lists are worked off by runs of bounded length, and
#: masked texts are cut by pieces: neither very many spans nor a very long text cost their square.
RUN, PIECE = 256, 1024
SPANS = "array<struct<start:int,end:int,kind:int,value:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where it is used for each element of another list."""
    return F.element_at(F.transform(F.array(value), use), 1)


def by_runs(items: Column, carry: Callable[[Column], Column], work: Callable[[Column, Column, Column], Column]) -> Column:
    """A list worked off by runs: ``carry`` says of a run what others need of it, ``work`` makes the run's part of the
    result of the run and of what those before and behind it carry."""

    def parts(every: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(every), F.lit(1)), F.lit(RUN))
        run = lambda at: F.slice(every, at, RUN)
        each = lambda all_carried: F.transform(starts, lambda at, i: work(run(at), F.slice(all_carried, 1, i), F.slice(all_carried, i + 2, F.size(all_carried))))
        return F.flatten(bound(F.transform(starts, lambda at: carry(run(at))), each))

    return bound(items, parts)


def spans(text: Column, pattern: str, kind: int, group: int, least: int, maybe: Column) -> Column:
    """Array of (start, end, kind, value): leftmost non-overlapping matches whose group has ``least`` characters.

    Splitting at the pattern gives the pieces between matches; the k-th match starts after k+1 pieces and k matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))), value, lambda s, v: F.struct(s["g"].alias("g"), s["m"].alias("m"), v.alias("v")))
    steps = F.filter(steps, lambda s: s["m"].isNotNull())
    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["g"]
        end = begin + s["m"]
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), s["v"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(s["v"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    total = lambda sizes: F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
    size = lambda run: total(F.transform(run, lambda s: s["g"] + s["m"]))
    none = F.array().cast(SPANS)
    placed = lambda run, before, _: F.aggregate(run, F.struct(total(before).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(maybe, by_runs(steps, size, placed)).otherwise(none)


def uncovered(base: Column, extra: Column) -> Column:
    """The spans of ``extra``, which do not overlap each other, that overlap none of ``base``: one sweep over both by
    their starts, in which a span of ``extra`` waits until no base span can start within it."""
    nothing = F.lit(None).cast(SPANS[6:-1])
    listed = lambda s: F.when(s.isNotNull(), F.array(s)).otherwise(F.array().cast(SPANS))

    def step(acc: Column, s: Column) -> Column:
        is_base = s["kind"] < 3
        clear = F.when(is_base, F.when(acc["wait"]["end"] <= s["start"], acc["wait"])).otherwise(F.when(acc["reach"] <= s["start"], s))
        reach = F.when(is_base, F.greatest(acc["reach"], s["end"])).otherwise(acc["reach"])
        return F.struct(reach.alias("reach"), clear.alias("wait"), F.when(is_base, acc["out"]).otherwise(F.concat(acc["out"], listed(acc["wait"]))).alias("out"))

    def carried(run: Column) -> Column:
        only = F.filter(run, lambda s: s["kind"] < 3)
        return F.struct(F.array_min(F.transform(only, lambda s: s["start"])).alias("first"), F.array_max(F.transform(only, lambda s: s["end"])).alias("reach"))

    def swept(run: Column, before: Column, behind: Column) -> Column:
        reach = F.coalesce(F.array_max(F.transform(before, lambda c: c["reach"])), F.lit(0))
        first = F.array_min(F.transform(behind, lambda c: c["first"]))
        start = F.struct(reach.alias("reach"), nothing.alias("wait"), F.array().cast(SPANS).alias("out"))
        last = lambda acc: F.when(first.isNull() | (acc["wait"]["end"] <= first), acc["wait"])
        return F.aggregate(run, start, step, lambda acc: F.concat(acc["out"], listed(last(acc))))

    return F.when(F.size(extra) > 0, by_runs(F.array_sort(F.concat(base, extra)), carried, swept)).otherwise(extra)


def masked(text: Column, masks: Column, mask: str) -> Column:
    """The text with sorted spans (start, end) replaced by ``mask``; a span that overlaps the one before makes that longer."""

    def step(acc: Column, s: Column) -> Column:
        kept = F.array(F.struct(acc["at"].alias("lo"), s["start"].alias("hi")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], kept)).otherwise(acc["out"]).alias("out"))

    def ranges(run: Column, before: Column, _: Column) -> Column:
        start = F.struct(F.coalesce(F.array_max(before), F.lit(0)).alias("at"), F.array().cast("array<struct<lo:int,hi:int>>").alias("out"))
        return F.aggregate(run, start, step, lambda acc: acc["out"])

    reach = lambda run: F.array_max(F.transform(run, lambda s: s["end"]))
    tail = F.struct(reach(masks).alias("lo"), F.length(text).alias("hi"))

    def cut(pieces: Column) -> Column:
        def between(r: Column) -> Column:
            first = F.floor(r["lo"] / PIECE).cast("int")  # of the pieces that hold these characters
            some = F.array_join(F.slice(pieces, first + 1, F.ceil(r["hi"] / PIECE).cast("int") - first), "")
            return F.when(r["hi"] > r["lo"], some.substr(r["lo"] - first * PIECE + 1, r["hi"] - r["lo"])).otherwise("")

        return F.array_join(F.transform(F.concat(by_runs(masks, reach, ranges), F.array(tail)), between), mask)

    return bound(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)), cut)


def _listed(col: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(col), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _candidates(docs: DataFrame, min_key: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One narrow row per document: row, doc_id, th (hash of the text), source, found (start, end, kind, value hash)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = r"[A-Za-z0-9+/_-]{%d,}" % min_key  # whole runs; which of them are key-like is told below
    base = F.concat(spans(text, ASSIGN, 0, 2, 12, text.rlike(ASSIGN_HINT)), spans(text, ACCESS, 1, 0, 18, text.contains("AKIA")), spans(text, HEX, 2, 0, 16, text.rlike(HEX)))
    scanned = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(source_col).alias("source"), base.alias("base"), spans(text, key, 3, 0, min_key, text.rlike(key)).alias("extra"))
    keyed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    extra = bound(F.filter("extra", lambda e: keyed(e["value"])), lambda e: uncovered(F.col("base"), e))
    hashed = F.transform(F.concat("base", extra), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.xxhash64(s["value"]).alias("vh")))
    return written(scanned.select("doc_id", "th", "source", hashed.alias("found")).withColumn("row", F.monotonically_increasing_id()), "candidates")


def _findings(rows: DataFrame, max_owners: int, max_documents: int) -> DataFrame:
    """row, doc_id, th, start, end, kind, live: one row per reported span, written."""
    each = rows.where(F.size("found") > 0).select("row", "doc_id", "th", "source", F.explode("found").alias("f"))
    # one row a value, text and owner, then one a value and text or a value and owner: every step combines on the map side first
    seen = each.select(F.col("f.vh").alias("vh"), "th", "source").distinct()
    texts = seen.select("vh", "th").distinct().groupBy("vh").agg(F.count("*").alias("documents"))
    owners = seen.select("vh", "source").distinct().groupBy("vh").agg(F.count("*").alias("owners"))
    widely = (F.col("owners") > max_owners) | ((F.col("owners") > 1) & (F.col("documents") > max_documents))
    examples = written(owners.join(texts, "vh").where(widely).select("vh"), "examples")
    spread = each.select("row", "doc_id", "th", "f").join(examples.withColumn("example", F.lit(True)), F.col("f.vh") == F.col("vh"), "left")
    found = written(spread.select("row", "doc_id", "th", "f.start", "f.end", "f.kind", F.col("example").isNull().alias("live")).where("kind < 3 or live"), "findings")
    drop(examples)
    return found


def scan_secrets(docs: DataFrame, *, max_owners: int = 2, max_documents: int = 20, min_key: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, findings (start, kind, end, live)."""
    rows = _candidates(docs, min_key, id_col, text_col, source_col)
    per_row = _findings(rows, max_owners, max_documents).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("findings"))
    out = rows.select("row", "doc_id").join(per_row, "row", "left").withColumn("findings", F.coalesce("findings", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")))
    out = out.withColumn("base", F.filter("findings", lambda s: s["kind"] < 3))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("findings").alias("spans"),
        F.size(F.filter("findings", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("base", lambda s: ~s["live"])).cast("long").alias("n_example"), "findings",
    )


def redact_secrets(docs: DataFrame, *, mask: str = "[SECRET]", max_owners: int = 2, max_documents: int = 20, min_key: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents with every live span replaced by ``mask``; published examples and all other text stay."""
    rows = _candidates(docs, min_key, id_col, text_col, source_col)
    findings = _findings(rows, max_owners, max_documents)
    h, d, t, masks = (unused(n, docs) for n in ("text_hash", "live_id", "live_hash", "live"))
    live = findings.where("live").select(F.col("doc_id").alias(d), F.col("th").alias(t), F.struct("start", "end").alias("s"))
    live = written(live.groupBy(d, t).agg(F.array_sort(F.collect_set("s")).alias(masks)), "masks")
    drop(rows, findings)
    text = F.col(text_col)
    joined = docs.withColumn(h, F.xxhash64(text_col)).join(live, F.col(id_col).eqNullSafe(F.col(d)) & (F.col(h) == F.col(t)), "left")
    return joined.select(*[F.when(F.col(masks).isNull(), text).otherwise(masked(text, F.col(masks), mask)).alias(c) if c == text_col else each for c, each in zip(docs.columns, own(docs))])
