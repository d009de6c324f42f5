"""Line dedup: later copies of repeated line runs go, found by a suffix array over line ids.

All documents are one sequence of line ids, ordered by doc_id; a run never crosses documents. The suffix
array is built by prefix doubling: ranks of single lines order all suffixes by their first line; the ranks
at ``i`` and ``i + 2**k``, sorted as pairs, order them by ``2**(k + 1)`` lines. Suffixes of equal rank
are an interval of the suffix array in which neighbours have a common prefix of at least ``2**k``
lines. A suffix that is alone in its interval is in its final place and leaves the work, so each
step only holds lines that still repeat.

In an interval of depth ``2**k`` all members but the earliest start a later copy of that many lines. A repeated
run of any length is the union of two such windows, so the windows together cover exactly the maximal
repeated runs. Windows of fewer than ``min_chars`` characters do not count, which leaves stray short lines.

Everything is DataFrame functions. Intervals are counted before anything is shuffled to them;
ranks are given to distinct pairs by a distributed sort; lines get theirs in joins that may be
split where a line is very common. No task holds an interval.

Defined results: null texts stay null and have no lines. Lines without a character other than spaces belong to no
run; those inside a deleted run go with it. Rows without a doc_id come first. Rows of one
doc_id and one text are one place in the sequence: no copies of each other, deleted alike. Extra columns
stay as they are; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.llm.common import packed, stored

MIN_CHARS = 10
BLANKS = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _sequence(documents: DataFrame) -> DataFrame:
    """One row per line with content: its document, place among such lines, number in the text, two hashes, characters."""
    numbered = F.transform(_lines(F.col("text")), lambda line, i: F.struct(i.alias("number"), line.alias("line"), F.length(F.btrim(line, F.lit(BLANKS))).alias("chars")))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("version"), F.posexplode(F.filter(numbered, lambda s: s["chars"] > 0))
    )
    line = F.col("col.line")
    return rows.select(
        "doc", "version", "pos", F.col("col.number").alias("number"), F.col("col.chars").cast("long").alias("chars"),
        F.xxhash64(line).alias("left"), F.xxhash64(F.lit(1), line).alias("right"),
    )


def _ranked(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose (left, right) is not alone, with the pair's rank among all pairs and its earliest place."""
    place = F.struct("doc", "version", "pos")
    pairs = rows.groupBy("left", "right").agg(
        F.min(place).alias("first"), F.max(place).alias("last")
    ).filter("first != last").drop("last").orderBy("left", "right")
    pairs = stored(pairs.withColumn("rank", F.monotonically_increasing_id()), f"{name}-pairs")
    return stored(rows.join(pairs, ["left", "right"]).drop("left", "right"), name)


def suffix_ranks(documents: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ... the suffixes that share their first 2**k lines with others, ranked, while there are any."""
    level, out = _ranked(_sequence(documents.filter("text is not null")), "suffixes"), []
    while not level.isEmpty():
        out.append(level)
        reach = 1 << (len(out) - 1)
        ahead = Window.partitionBy("doc", "version").orderBy("pos").rangeBetween(reach, reach)
        wider = level.select(
            "doc", "version", "pos", "number", F.col("rank").alias("left"), F.first("rank").over(ahead).alias("right"),
            (F.col("chars") + F.first("chars").over(ahead)).alias("chars"),
        ).filter("right is not null")
        level = _ranked(wider, "suffixes")
    return out


def repeated_runs(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, version and ``runs``: the maximal stretches of lines (first and last number) that are later copies."""
    levels = suffix_ranks(documents)
    if not levels:
        return documents.sparkSession.createDataFrame([], "doc long, version long, runs array<struct<first:int,last:int>>, n_deleted long")
    later = None
    for k, level in enumerate(levels):
        copies = level.filter((F.col("first") < F.struct("doc", "version", "pos")) & (F.col("chars") >= min_chars))
        copies = copies.select("doc", "version", "pos", (F.col("pos") + (1 << k)).alias("end"))
        later = copies if later is None else later.unionByName(copies)
    places = levels[0].select("doc", "version", "pos", "number", F.lit(None).cast("int").alias("end")).unionByName(
        later.withColumn("number", F.lit(None).cast("int")), allowMissingColumns=True
    )
    lines = places.groupBy("doc", "version", "pos").agg(F.max("number").alias("number"), F.max("end").alias("end"))
    document = Window.partitionBy("doc", "version").orderBy("pos")
    lines = lines.withColumn("reach", F.max("end").over(document)).filter("reach > pos")
    # consecutive places have one difference to their ordinal
    lines = lines.withColumn("run", F.col("pos") - F.row_number().over(document))
    runs = lines.groupBy("doc", "version", "run").agg(
        F.min("number").alias("first"), F.max("number").alias("last"), F.count(F.lit(1)).alias("lines")
    )
    return stored(
        runs.groupBy("doc", "version").agg(
            F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"), F.sum("lines").alias("n_deleted")
        ),
        "runs",
    )


def _outside(lines: Column, runs: Column) -> Column:
    """The lines that no run covers: the stretches before, between and behind the ascending runs."""
    stops = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["last"] + 1))
    return F.flatten(F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda s: F.slice(lines, s["a"] + 1, s["b"] - s["a"])))


def _deduped(documents: DataFrame, min_chars: int) -> DataFrame:
    """``given``, all columns of a row, and its text without later copies, its lines with content and how many of them went."""
    runs = repeated_runs(documents, min_chars)
    rows = documents.select(packed(documents), F.col("text").alias("old"))
    match = F.col("given.doc_id").cast("long").eqNullSafe(F.col("doc")) & (F.xxhash64("old") == F.col("version"))
    joined = rows.join(runs.hint("shuffle_merge"), match, "left")
    text = F.when(F.col("runs").isNull(), F.col("old")).otherwise(F.array_join(_outside(_lines(F.col("old")), F.col("runs")), "\n"))
    count = F.size(F.filter(_lines(F.col("old")), lambda line: F.btrim(line, F.lit(BLANKS)) != ""))
    return joined.select(
        "given", text.alias("text"), F.when(F.col("old").isNull(), 0).otherwise(count).cast("long").alias("n_lines"),
        F.coalesce("n_deleted", F.lit(0)).cast("long").alias("n_deleted"),
    )


def dedupe_lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``documents``, the text without later copies, and ``n_lines`` and ``n_deleted`` (lines with content).

    These two names are the operator's: columns of the input that are called so give way. ``clean_rows`` keeps them.
    """
    kept = [c for c in documents.columns if c not in ("n_lines", "n_deleted")]
    found = _deduped(documents, min_chars)
    return found.select(*[F.col("text") if c == "text" else F.col("given")[c].alias(c) for c in kept], "n_lines", "n_deleted")


def clean_rows(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``documents`` with cleaned texts, all other columns as they were; rows of which no line is left go.

    A column ``n_chars`` counts the characters of the new text.
    """
    found = _deduped(documents, min_chars).filter("n_deleted < n_lines or n_lines = 0")
    own = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        own["n_chars"] = F.length("text").cast(documents.schema["n_chars"].dataType).alias("n_chars")
    return found.select(*[own.get(c, F.col("given")[c].alias(c)) for c in documents.columns])


#: DuckDB SQL for the same windows, compared as text: windows of 1, 2, 4, ... lines with an earlier equal one.
ORACLE = """
with lines as (
  select doc_id, line, i - 1 as number, row_number() over (partition by doc_id order by i) - 1 as pos,
    length(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) as chars
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
  where trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
), lists as (
  select doc_id, list(line order by pos) as ls, list(chars order by pos) as cs, count(*) as n from lines group by doc_id
), windows as (
  select doc_id, pos, len, array_to_string(ls[pos + 1 : pos + len], chr(10)) as content, list_sum(cs[pos + 1 : pos + len]) as chars
  from (select *, unnest(range(0, n)) as pos from lists), (select unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096]) as len)
  where pos + len <= n
), later as (
  select doc_id, pos, len from (
    select doc_id, pos, len, chars, row_number() over (partition by len, content order by doc_id, pos) as nth from windows
  ) where nth > 1 and chars >= 10
), reached as (
  select l.doc_id, l.pos, l.number, max(w.stop) over (partition by l.doc_id order by l.pos) as reach
  from lines l left join (select doc_id, pos, max(pos + len) as stop from later group by all) w on l.doc_id = w.doc_id and l.pos = w.pos
), gone as (
  select doc_id, number, pos - row_number() over (partition by doc_id order by pos) as run from reached where reach > pos
), runs as (
  select doc_id, min(number) as lo, max(number) as hi, count(*) as n from gone group by doc_id, run
), kept as (
  select x.doc_id, string_agg(x.line, chr(10) order by x.i) as text
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) x
  where not exists (select 1 from runs r where r.doc_id = x.doc_id and x.i - 1 between r.lo and r.hi)
  group by x.doc_id
)
select d.doc_id, coalesce(k.text, case when d.text is null then null else '' end) as text,
  (select count(*) from lines l where l.doc_id = d.doc_id) as n_lines,
  coalesce((select sum(n) from runs r where r.doc_id = d.doc_id), 0)::bigint as n_deleted
from documents d left join kept k on d.doc_id = k.doc_id
"""
