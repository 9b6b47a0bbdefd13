"""Joins of line ranges, coverage and snippets (IDs J02 - J04, J09, J13 - J18, W15, W16, F32, X12, P14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from scryline.functions.text import lower_path, path_suffixes, referenced_symbols
from scryline.operators.alike import classes, joined, stored


def overlapping(queries: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Queries (keys, q_start, q_end) with the chunks (keys, line_start, line_end) that overlap: equal keys, ranges as residue."""
    return queries.join(chunks, keys).where((F.col("line_start") <= F.col("q_end")) & (F.col("line_end") >= F.col("q_start")))


def bucketed_overlap(queries: DataFrame, chunks: DataFrame, keys: list[str], width: int) -> DataFrame:
    """J02 for keys with many ranges: both sides are dealt to buckets of `width` lines, and a pair counts in its first common one."""
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))
    q = queries.withColumn("_cell", F.explode(cells("q_start", "q_end")))
    c = chunks.withColumn("_cell", F.explode(cells("line_start", "line_end")))
    both = q.join(c, [*keys, "_cell"]).where((F.col("line_start") <= F.col("q_end")) & (F.col("line_end") >= F.col("q_start")))
    return both.where(F.col("_cell") == F.floor(F.greatest("q_start", "line_start") / width)).drop("_cell")


def overlap_counts(queries: DataFrame, chunks: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Queries with n, how many chunks overlap each (those that none overlaps go). Equal ranges are counted first, so different ranges meet, however many rows have them."""
    asked = queries.select(*keys, "q_start", "q_end").distinct()
    held = chunks.groupBy(*keys, "line_start", "line_end").agg(F.count("*").alias("n"))
    counts = bucketed_overlap(asked, held, keys, width).groupBy(*keys, "q_start", "q_end").agg(F.sum("n").alias("n"))
    return joined(queries, stored(counts, "overlap-counts"), [*keys, "q_start", "q_end"])


#: Lines of a cell in which places meet.
PLACE_LINES = 64


def places_met(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Actual (keys, path, a_start, a_end, ...) with the expected (keys, e_path, line_start, line_end, ...) whose path its own is or ends in, and whose lines overlap.

    Each actual path stands for all its endings, so it meets an expected path as a whole and only in common cells of lines: places of one
    bare name, or of one long file, don't all meet.
    """
    a = actual.withColumn("_place", F.explode(path_suffixes(F.col("path")))).withColumnsRenamed({"a_start": "q_start", "a_end": "q_end"})
    e = expected.withColumn("_place", lower_path(F.col("e_path")))
    return bucketed_overlap(a, e, [*keys, "_place"], PLACE_LINES).drop("_place", "q_start", "q_end")


#: Lines of a cell within which ranges are merged first.
CELL_LINES = 4096


def merged(points: DataFrame, keys: list[str], merge: list | None = None, touch: int = 0, cell: int = CELL_LINES, rows: DataFrame | None = None) -> DataFrame:
    """Overlapping ranges (line_start, line_end) within keys as one, with the aggregates `merge`, which have the names of what they add up.

    Ranges are merged within cells of lines first and what is left over all cells then, since merged ranges merge like any others. So a file
    of many rows is worked on by as many tasks as it has cells, and only its ranges that lie apart meet. touch: 1 to merge neighbours, too.
    Rows that share a start should be one already (see `by_start`), else a line of many rows is one group. rows: what the points were made of; where
    none of them reaches into another cell, no merged range does, and the ranges aren't shuffled again.
    """
    out = points.withColumn("_cell", F.floor(F.col("line_start") / cell))
    within = rows is not None and rows.where(F.floor((F.col("line_end") + touch) / cell) > F.floor(F.col("line_start") / cell)).select("line_start").limit(1).count() == 0
    for own in ([*keys, "_cell"], *([] if within else [keys])):
        order = Window.partitionBy(*own).orderBy("line_start", "line_end")
        before = F.max("line_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.when(before.isNull() | (F.col("line_start") > before + touch), 1).otherwise(0)
        out = out.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        out = out.groupBy(*own, "_island").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), *(merge or []))
    return out.drop("_island", "_cell")


def by_start(rows: DataFrame, keys: list[str], *facts) -> DataFrame:
    """One row for each start within keys, with the greatest end: no key has more rows than its file has lines. Combined before the shuffle."""
    return rows.groupBy(*keys, "line_start").agg(F.max("line_end").alias("line_end"), *facts)


def first_containing(queries: DataFrame, chunks: DataFrame, keys: list[str], query_id: str, line: str, columns: list[str]) -> DataFrame:
    """For each query the chunk of least index whose lines hold the query's line.

    Of chunks with the same lines the first counts, and each different line looks among the ranges of its cell; the queries themselves meet its answer only.
    """
    firsts = chunks.groupBy(*keys, "line_start", "line_end").agg(F.min(F.struct("chunk_index", *columns)).alias("b"))
    ranges = firsts.where("line_start <= line_end").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("line_start") / PLACE_LINES), F.floor(F.col("line_end") / PLACE_LINES))))
    lines = queries.select(*keys, F.col(line).alias("_line")).distinct().withColumn("_cell", F.floor(F.col("_line") / PLACE_LINES))
    hit = lines.join(ranges, [*keys, "_cell"]).where(F.col("_line").between(F.col("line_start"), F.col("line_end")))
    found = stored(hit.groupBy(*keys, F.col("_line").alias(line)).agg(F.min("b").alias("b")), "first-containing")
    best = joined(queries.select(query_id, *keys, line), found, [*keys, line]).groupBy(query_id).agg(F.min("b").alias("b"))
    return best.select(query_id, "b.*")


def with_static_issues(chunks: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """Chunks that an issue touches. Issues without a path count for all files: they are aggregated to one row a range."""
    i = issues.where("line_start is not null").select("file_path", "line_start", F.coalesce("line_end", "line_start").alias("i_end")).distinct()
    touch = (F.col("c.line_start") <= F.col("i.i_end")) & (F.col("c.line_end") >= F.col("i.line_start"))
    c = chunks.alias("c")
    named = c.join(i.where("file_path is not null").alias("i"), (F.col("c.file_path") == F.col("i.file_path")) & touch, "left_semi")
    # issues of no file meet chunks by cells of 50 lines, so this is an equi-join too
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 50), F.floor(F.col(b) / 50)))
    loose = i.where("file_path is null").withColumn("_cell", cells("line_start", "i_end")).select("_cell", F.col("line_start").alias("_s"), F.col("i_end").alias("_e")).distinct()
    free = chunks.withColumn("_cell", cells("line_start", "line_end")).join(loose, "_cell").where("line_start <= _e and line_end >= _s").drop("_cell", "_s", "_e")
    return named.unionByName(free).dropDuplicates([key])


def trace_chunk_keys(traces: DataFrame) -> DataFrame:
    """Distinct chunks that retrieval returned. traces (tool_name, output struct<status, results array<struct<file_path, chunk_index>>>)."""
    rows = traces.where((F.col("tool_name") == "probe_retrieval") & (F.col("output.status") == "ok")).select(F.explode("output.results").alias("r"))
    return rows.select(F.col("r.file_path").alias("file_path"), F.col("r.chunk_index").try_cast("int").alias("chunk_index")).where("file_path is not null and chunk_index is not null").distinct()


def coverage(expected: DataFrame, reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many keys are expected, how many of them reviewed."""
    r = reviewed.select(*keys).distinct().withColumn("_r", F.lit(1))
    return expected.select(*keys).distinct().join(r, keys, "left").agg(F.count("*").alias("expected"), F.count("_r").alias("reviewed"))


def missing(expected: DataFrame, reviewed: DataFrame, keys: list[str], limit: int = 25) -> DataFrame:
    """The first keys that aren't reviewed."""
    return expected.select(*keys).distinct().join(reviewed.select(*keys).distinct(), keys, "left_anti").orderBy(*keys).limit(limit)


def covered(targets: DataFrame, pieces: DataFrame, keys: list[str], target_id: str, width: int = 256) -> DataFrame:
    """Targets (keys, target_id, a, b), pieces (keys, line_start, line_end) -> target_id, covered: do the pieces cover a to b without a gap?

    Pieces are merged, neighbours too; then one merged range must hold the whole target. Each is dealt to the cells of `width` lines that it reaches, a
    target to that of its first line, where it meets the ranges of that cell alone: half its lines at most.
    """
    whole = merged(by_start(pieces.where("line_start <= line_end"), keys), keys, touch=1)
    cells = whole.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("line_start") / width), F.floor(F.col("line_end") / width))))
    held = targets.withColumn("_cell", F.floor(F.col("a") / width)).join(cells, [*keys, "_cell"]).where((F.col("line_start") <= F.col("a")) & (F.col("line_end") >= F.col("b")))
    found = held.select(target_id).distinct().withColumn("_in", F.lit(True))
    return targets.select(target_id).join(found, target_id, "left").select(target_id, F.coalesce("_in", F.lit(False)).alias("covered"))


def gaps(pieces: DataFrame, keys: list[str], total: str) -> DataFrame:
    """Keys, gap_start, gap_end: the lines of 1 to total that no piece covers."""
    whole = merged(by_start(pieces, keys, F.max(total).alias("_t")), keys, [F.max("_t").alias("_t")], touch=1)
    order = Window.partitionBy(*keys).orderBy("line_start")
    rows = whole.withColumn("_s", F.coalesce(F.lag("line_end").over(order), F.lit(0))).withColumn("_last", F.lead("line_end").over(order).isNull()).withColumn("_t", F.max("_t").over(Window.partitionBy(*keys)))
    inner = F.when(F.col("line_start") > F.col("_s") + 1, F.struct((F.col("_s") + 1).alias("gap_start"), (F.col("line_start") - 1).alias("gap_end")))
    tail = F.when(F.col("_last") & (F.col("line_end") < F.col("_t")), F.struct((F.col("line_end") + 1).alias("gap_start"), F.col("_t").alias("gap_end")))
    return rows.select(*keys, F.inline(F.filter(F.array(inner, tail), lambda g: g.isNotNull())))


def snippet(chunks: DataFrame, queries: DataFrame, keys: list[str], query_id: str, around: int = 3) -> DataFrame:
    """query_id, first_line, snippet: the lines around q_start to q_end out of overlapping chunks; the later chunk wins a line, gaps are empty.

    A range's lines are few (its own and `around` on both sides), so only they are spelled out, once for each different range; of the chunks, first the index of
    the one that wins each line, then its text. Queries of one range share the answer.
    """
    spans = classes(queries, [*keys, "q_start", "q_end"], "_span", "spans")
    first, last = F.greatest(F.col("q_start") - around, F.lit(1)), F.col("q_end") + around
    lines = spans.dropna(subset=keys).where(first <= last).select(*keys, "_span", F.explode(F.sequence(first, last)).alias("line"))
    wanted = stored(lines.select(*keys, "line").distinct(), "wanted-lines")
    end = F.least("line_end", F.col("line_start") + F.size(F.split("content", "\n")) - 1)
    held = chunks.withColumn("_end", end).where("line_start <= _end")
    each = joined(held.select(*keys, "chunk_index", F.explode(F.sequence("line_start", "_end")).alias("line")), wanted, [*keys, "line"], "left_semi")
    winners = stored(each.groupBy(*keys, "line").agg(F.max("chunk_index").alias("chunk_index")), "winning-chunks")
    text = joined(held, winners, [*keys, "chunk_index"]).where("line between line_start and _end").select(*keys, "line", "chunk_index", F.element_at(F.split("content", "\n"), (F.col("line") - F.col("line_start") + 1).cast("int")).alias("text"))
    texts = stored(text.groupBy(*keys, "line", "chunk_index").agg(F.max("text").alias("text")), "winning-lines")  # chunks of one index and file count as one

    def spelt(rows: DataFrame, of: str) -> DataFrame:
        """of, first_line, snippet from of, line, text."""
        got = rows.groupBy(of).agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.map_from_entries(F.collect_list(F.struct("line", "text"))).alias("m"))
        return got.select(of, "first_line", F.array_join(F.transform(F.sequence("first_line", "last_line"), lambda n: F.coalesce(F.element_at("m", n), F.lit(""))), "\n").alias("snippet"))

    of_span = stored(joined(lines, texts, [*keys, "line"]).select("_span", "line", "chunk_index", "text"), "span-lines")
    snippets = stored(spelt(of_span, "_span"), "snippets")
    per = joined(queries.select(query_id, *keys, "q_start", "q_end"), spans, [*keys, "q_start", "q_end"]).groupBy(query_id).agg(F.collect_set("_span").alias("_spans"))
    one = joined(per.where("size(_spans) = 1").select(query_id, F.get("_spans", 0).alias("_span")), snippets, ["_span"])
    more = joined(per.where("size(_spans) > 1").select(query_id, F.explode("_spans").alias("_span")), of_span, ["_span"]).groupBy(query_id, "line").agg(F.max_by("text", "chunk_index").alias("text"))
    return one.select(query_id, "first_line", "snippet").unionByName(spelt(more, query_id))


def adjacent(anchors: DataFrame, chunks: DataFrame, probe: str = "probe_id") -> DataFrame:
    """Anchors (probe, file_path, chunk_index, anchor_rank from 0) -> their neighbours, score raised by 2 / (rank + 1); the last anchor counts where two share one."""
    near = anchors.select(probe, "file_path", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index"), "anchor_rank")
    near = near.groupBy(probe, "file_path", "chunk_index").agg(F.max("anchor_rank").alias("anchor_rank"))
    fresh = near.join(anchors.select(probe, "file_path", "chunk_index"), [probe, "file_path", "chunk_index"], "left_anti")
    return fresh.join(chunks, ["file_path", "chunk_index"]).withColumn("bonus", 2.0 / (F.col("anchor_rank") + 1))


def symbol_related(anchors: DataFrame, chunks: DataFrame, text: str, probe: str = "probe_id") -> DataFrame:
    """Chunks that mention a symbol of an anchor (probe, anchor_rank, content), with the greatest priority 2 / (rank + 1).

    Words of the chunks meet the symbols by an equi-join on the word.
    """
    symbols = anchors.select(probe, "anchor_rank", F.explode(referenced_symbols(F.col("content"))).alias("word")).groupBy(probe, "word").agg((2.0 / (F.min("anchor_rank") + 1)).alias("priority"))
    words = chunks.select("file_path", "chunk_index", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)))).alias("word"))
    return words.join(symbols, "word").groupBy(probe, "file_path", "chunk_index").agg(F.max("priority").alias("priority"))


def nested_pairs(chunks: DataFrame, keys: list[str], chunk_id: str) -> DataFrame:
    """Outer, inner: of each chunk that lies in another of its file, the narrowest other that holds it."""
    inner = chunks.select(*keys, F.col(chunk_id).alias("inner"), F.col("line_start").alias("_a"), F.col("line_end").alias("_b"))
    both = inner.join(chunks.select(*keys, F.col(chunk_id).alias("outer"), "line_start", "line_end"), keys)
    held = both.where((F.col("line_start") <= F.col("_a")) & (F.col("line_end") >= F.col("_b")) & (F.col("outer") != F.col("inner")))
    return held.groupBy("inner").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("w"), F.col("outer").alias("o"))).alias("b")).select("inner", F.col("b.o").alias("outer"))


def evidence_supported(refs: DataFrame, chunks: DataFrame, candidate: str) -> DataFrame:
    """Candidates all of whose evidence (file_path, chunk_index, e_start, e_end) overlaps its chunk, and whose own first and last line each lie in one."""
    c = chunks.select("file_path", "chunk_index", "line_start", "line_end")
    hit = refs.join(c, ["file_path", "chunk_index"], "left")
    ok = F.coalesce((F.col("line_start") <= F.col("e_end")) & (F.col("line_end") >= F.col("e_start")), F.lit(False))
    holds = lambda x: F.bool_or(F.coalesce(F.col(x).between(F.col("line_start"), F.col("line_end")), F.lit(False)))
    return hit.groupBy(candidate).agg(F.bool_and(ok).alias("_all"), holds("issue_start").alias("_a"), holds("issue_end").alias("_b")).where("_all and _a and _b").select(candidate)


def expected_keys(plan: DataFrame) -> DataFrame:
    """Plan (files array<struct<file_path, required_chunk_indexes>>) -> distinct keys."""
    return plan.select(F.explode("files").alias("f")).select(F.col("f.file_path").alias("file_path"), F.explode("f.required_chunk_indexes").alias("chunk_index")).distinct()
