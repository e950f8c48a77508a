"""Joins of documents with records: lookups, aliases, links, scope, times, boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import norm_locator
from lectern.storage import materialize

MISSES = 3  # failed tries that a stamp is given


def lookup_paths(path: Column) -> Column:
    """Paths under which a record may know a file: its own, and that of every file whose
    asset folder it is in, so that a prefix join is an equi-join."""
    parts = F.split(path, "/")
    owners = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.endswith(parts[i - 1], F.lit(".assets")))
    inside = F.transform(owners, lambda i: F.regexp_replace(F.array_join(F.slice(parts, 1, i), "/"), r"\.assets$", ""))
    return F.array_union(F.array(path), inside)


def record_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(path, course, item)``: the first item of each course that knows a document by
    its path or text path.  ``items`` has course, item, position, path and text."""
    known = items.select("course", "item", "position", F.explode(F.array_distinct(F.array_compact(F.array("path", "text")))).alias("known"))
    hits = documents.select("path", F.explode(lookup_paths(F.col("path"))).alias("known")).join(known, "known")
    first = F.min_by("item", F.struct("position", "item"))
    return hits.groupBy("path", "course").agg(first.alias("item"))


def material_status(documents: DataFrame, records: DataFrame, removed: Column) -> DataFrame:
    """``documents`` with ``availability``: removed, else their record's, else a marker of
    their own, else current."""
    joined = documents.join(records.select("path", F.col("status").alias("__status"), "stale", "locked"), "path", "left")
    status = (
        F.when(removed, "removed").when(F.col("locked") | (F.col("__status") == "locked"), "restricted")
        .when(F.col("stale") | F.col("__status").isin("failed", "pending"), "stale").when(F.col("__status").isNotNull(), "current")
    )
    return joined.withColumn("availability", F.coalesce(status, F.col("marker"), F.lit("current"))).drop("__status", "stale", "locked")


def first_of(rows: DataFrame, keys: Sequence[str], choices: Sequence[DataFrame], value: str) -> DataFrame:
    """``rows`` with ``value`` from the first of ``choices`` that knows their key; the n-th
    choice is joined on the n-th of ``keys``."""
    out = rows
    for n, (key, choice) in enumerate(zip(keys, choices, strict=True)):
        out = out.join(choice.select(F.col(key), F.col(value).alias(f"__choice_{n}")).dropDuplicates([key]), key, "left")
    names = [f"__choice_{n}" for n in range(len(choices))]
    return out.withColumn(value, F.coalesce(*names)).drop(*names)


def in_scope(links: DataFrame, sources: DataFrame, selected: DataFrame) -> DataFrame:
    """``sources`` with their ``modules`` and ``in_scope``: linked from a selected module, or
    from none at all.  ``links`` has module and path, ``selected`` has module."""
    marked = links.join(selected.select("module", F.lit(True).alias("on")), "module", "left")
    by_path = marked.groupBy("path").agg(F.sort_array(F.collect_set("module")).alias("modules"), F.max(F.coalesce("on", F.lit(False))).alias("any"))
    joined = sources.join(by_path, "path", "left")
    return joined.withColumn("in_scope", F.coalesce("any", F.lit(True))).drop("any")


def merge_aliases(rows: DataFrame, key: str, contexts: str, order: Column) -> DataFrame:
    """One row for each recording that several listings name, with all its contexts; the
    other names become ``aliases``."""
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("name"))))
    return rows.groupBy(key).agg(ordered.alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(contexts)))).alias(contexts)).select(
        key, F.col("n")[0]["name"].alias("name"), F.transform(F.slice("n", 2, F.size("n")), lambda x: x["name"]).alias("aliases"), contexts
    )


def resolve_tokens(documents: DataFrame, targets: DataFrame, key: str, text: str, kinds: str = "canvas-[a-z]+") -> DataFrame:
    """``documents`` with link tokens ``(kind:id)`` in ``text`` replaced by ``(target)`` where
    ``targets`` (kind, id, target) knows one.  A text is cut before each of its tokens once;
    texts without tokens, and null ones, stay as they are."""
    rows = materialize(documents.withColumn("__row", F.monotonically_increasing_id()), "documents")
    token = rf"\(({kinds}):([^)\s]+)\)"
    parts = rows.where(F.col(text).rlike(token)).select("__row", F.posexplode(F.split(text, rf"(?={token})")).alias("__at", "__piece"))
    own = lambda n: F.regexp_extract("__piece", f"^{token}", n)
    named = parts.withColumns({"kind": own(1), "id": own(2), "__size": F.length(own(0))})
    known = named.join(targets.select("kind", "id", "target"), ["kind", "id"], "left")
    rest = F.expr("substring(__piece, __size + 1)")
    piece = F.when(F.col("target").isNull(), F.col("__piece")).otherwise(F.concat(F.lit("("), "target", F.lit(")"), rest))
    pieces = F.sort_array(F.collect_list(F.struct("__at", piece.alias("p"))))
    joined = known.groupBy("__row").agg(F.array_join(F.transform(pieces, lambda x: x["p"]), "").alias("__text"))
    return rows.join(joined, "__row", "left").withColumn(text, F.coalesce("__text", text)).drop("__row", "__text")


def by_locator(citations: DataFrame, sections: DataFrame) -> DataFrame:
    """``citations`` with ``sec_no`` or ``error``: a locator names a section by its heading, or
    by the number of its slide or page; more than one is ambiguous, none is missing."""
    own = norm_locator(F.col("locator"))
    number = F.regexp_extract(own, r"^((?:slide|page) \d+)\b", 1)
    names = sections.select("path", "sec_no", F.explode(F.array_distinct(F.filter(F.array(own, number), lambda n: n != ""))).alias("__name"))
    # one row a name before the join: a name of many sections meets its citations once
    opened = names.groupBy("path", "__name").agg(F.count_distinct("sec_no").alias("__n"), F.min("sec_no").alias("__sec_no"))
    found = citations.withColumn("__name", own).join(opened, ["path", "__name"], "left")
    error = F.when(F.col("__n").isNull(), "missing_locator").when(F.col("__n") > 1, "ambiguous_locator")
    return found.select(*citations.columns, error.alias("error"), F.when(F.col("__n") == 1, F.col("__sec_no")).alias("sec_no"))


def as_of(rows: DataFrame, versions: DataFrame, key: str, at: str, since: str) -> DataFrame:
    """``rows`` with the newest version of their key from before them (an as-of join): both are
    one sorted stream for each key, and the last version seen is carried on."""
    fields = [c for c in versions.columns if c != key]
    left = rows.select(F.col(key), F.col(at).alias("__t"), F.lit(1).alias("__o"), F.struct("*").alias("__row"), F.lit(None).cast(versions.select(F.struct(*fields)).schema[0].dataType).alias("__version"))
    right = versions.select(F.col(key), F.col(since).alias("__t"), F.lit(0).alias("__o"), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("__row"), F.struct(*fields).alias("__version"))
    carried = F.last("__version", ignorenulls=True).over(W.partitionBy(key).orderBy("__t", "__o").rowsBetween(W.unboundedPreceding, 0))
    both = left.unionByName(right).withColumn("__version", carried).where("__o = 1")
    return both.select("__row.*", F.col("__version").alias("version"))


def summary_state(summaries: DataFrame, sources: DataFrame) -> DataFrame:
    """``(summary, state)``: changed where a source's fingerprint is not the saved one, one is
    gone or new, or is newer than the summary; else current."""
    now = sources.groupBy("summary").agg(F.array_sort(F.collect_list(F.struct("path", "fingerprint"))).alias("now"), F.max("updated").alias("newest"))
    joined = summaries.join(now, "summary", "left")
    saved = F.array_sort(F.transform(F.map_entries("saved"), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("fingerprint"))))
    same = F.to_json(saved) == F.to_json("now")
    return joined.select("summary", F.when(same & (F.col("newest") <= F.col("written")), "current").otherwise("changed").alias("state"))


def labels_in_boxes(labels: DataFrame, boxes: DataFrame, page: str, grow: float = 0.25) -> DataFrame:
    """``(page, label, box)``: the smallest box of a page that a label's centre is in, boxes
    grown on all sides by ``grow`` of their size."""
    joined = labels.join(boxes, page)  # a page has few of either
    wide, high = F.col("w") * grow, F.col("h") * grow
    inside = F.col("cx").between(F.col("x") - wide, F.col("x") + F.col("w") + wide) & F.col("cy").between(F.col("y") - high, F.col("y") + F.col("h") + high)
    best = F.min(F.struct((F.col("w") * F.col("h")).alias("a"), "box"))
    return joined.where(inside).groupBy(page, "label").agg(best.alias("m")).select(page, "label", "m.box")


def incremental_index(old: DataFrame, files: DataFrame, key: str, stamp: str, build) -> DataFrame:
    """The rows of ``old`` whose file is there unchanged, and those that ``build`` makes of
    the files that are new or have changed.  A stamp may be null, which is a stamp of its own."""
    now = files.select(key, F.col(stamp).alias("__now"))
    kept = old.join(now, key).where(F.col(stamp).eqNullSafe(F.col("__now"))).drop("__now")
    had = old.select(key, F.col(stamp).alias("__had"), F.lit(True).alias("__known")).distinct()
    fresh = files.join(had, key, "left").where(F.col("__known").isNull() | ~F.col(stamp).eqNullSafe(F.col("__had"))).drop("__had", "__known")
    return kept.unionByName(build(fresh))


def retry_budget(tries: DataFrame, key: str) -> DataFrame:
    """``(key, stamp, misses, give_up)`` of the newest stamp: misses since its last success;
    after ``MISSES`` it is given up until the stamp changes."""
    newest = tries.withColumn("__last", F.max_by("stamp", "at").over(W.partitionBy(key))).where("stamp = __last")
    good = F.max(F.when(F.col("ok"), F.col("at"))).over(W.partitionBy(key))
    missed = newest.withColumn("__good", good).where(~F.col("ok") & (F.col("__good").isNull() | (F.col("at") > F.col("__good"))))
    counted = missed.groupBy(key).agg(F.count("*").alias("misses"))
    rows = newest.select(key, "stamp").distinct().join(counted, key, "left").withColumn("misses", F.coalesce("misses", F.lit(0)))
    return rows.withColumn("give_up", F.col("misses") >= MISSES)


def detail_view(rows: DataFrame, key: str, ids: Sequence[object], hidden: Sequence[str] = (), most: int = 50) -> DataFrame:
    """Rows of the given ids in their order, each once, without ``hidden`` columns."""
    asked = list(dict.fromkeys(ids))
    if len(asked) > most:
        raise ValueError(f"at most {most} ids")
    place = F.array_position(F.array(*map(F.lit, asked)), F.col(key))
    return rows.where(F.col(key).isin(asked)).withColumn("__place", place).orderBy("__place").drop("__place", *hidden)
