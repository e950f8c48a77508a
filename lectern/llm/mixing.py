"""Mixing sources to target weights: quotas of blocks, split down a tree of shards.

Each source is a stream: its documents in a keyed order, joined, repeated as epochs, and
cut into blocks of ``block_words`` words.  Its target buys whole blocks.  A binary tree
splits the blocks of all sources among the output shards: at each node the counts of the
left half are a multivariate hypergeometric draw, so a shard holds what a random deal of
exactly those blocks would give it.  A shard takes the next unused blocks of each
source's permuted stream, so draws are disjoint, and shuffles them by a keyed hash.

Everything is DataFrame and SQL functions.  The documents are read once for their sizes
and joined to the sources' totals; running sums go over keyed buckets of a source, so a
source with a third of all rows is many groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.offsets import running_offsets
from lectern.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3  # times a source may repeat
BLOCK_WORDS = 128
SHARDS = 16
SEED = 17
BUCKET_ROWS = 2_000  # documents of a source summed up in one group
BROADCAST_BYTES = 4 << 20  # larger source tables are joined by shuffling
STEPS = (1_000_000_007, 2_147_483_647, 998_244_353)  # primes over any block count, a permutation each


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, place, source_size, n_docs, weight, target double)`` of ``(source, size)``
    rows, one per source.

    Weights repeat over the sources by code point, null last; ``place`` counts them from 0.
    Targets over ``most`` times the source's size stop there; what they leave is shared
    again by weight until none is above.  Sources meet their cap in the order of cap over
    weight, so two running sums in that order tell the level at which the rest shares.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    named = totals.withColumns({"unknown": F.col("source").isNull(), "name": F.coalesce("source", F.lit("")), "one": F.lit(1).cast("long")})
    placed = running_offsets(named, ["unknown", "name"], "one", "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    capped = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("full_at", F.col("cap") / F.col("weight"))
    table = materialize(running_offsets(capped, ["full_at", "place"], {"cap": "caps", "weight": "weights"}), "sources")
    sizes_of, weights_of = (v or 0 for v in table.agg(F.sum("source_size"), F.sum("weight")).first())
    level = (F.lit(sizes_of) - F.col("caps")) / (F.lit(weights_of) - F.col("weights"))
    found = table.select("full_at", "place", level.alias("level")).where("full_at >= level")
    rest = found.agg(F.min(F.struct("full_at", "place", "level"))["level"]).first()[0]
    cap = F.col("cap").cast("double")
    target = cap if rest is None else F.least(F.col("weight") * F.lit(rest), cap)
    return table.select("source", "place", "source_size", "n_docs", F.col("weight").cast("double").alias("weight"), target.alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on nothing but ``parts``."""
    return (F.pmod(F.xxhash64(*parts), F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def hypergeometric(u: Column, pool: Column, marked: Column, drawn: Column) -> Column:
    """How many of ``marked`` are among ``drawn`` of ``pool``, at the quantile ``u``.

    Inverts the distribution over 9 standard deviations around the mean (all of it where
    it is narrower), from the ratios of neighbouring probabilities.
    """
    mean = marked * drawn.cast("double") / F.greatest(pool, F.lit(1))
    spread = F.sqrt(mean * (1 - marked / F.greatest(pool, F.lit(1))) + 1.0) * 9 + 2
    ends = F.struct(
        F.greatest(F.lit(0).cast("long"), drawn - (pool - marked), F.floor(mean - spread)).alias("low"),
        F.least(marked, drawn, F.ceil(mean + spread)).alias("high"),
    )

    def quantile(end: Column) -> Column:
        steps = F.sequence(end["low"], F.greatest(end["low"], end["high"]))

        def ratio(k: Column) -> Column:  # P(k + 1) / P(k)
            free = F.greatest(pool - marked - drawn + k + 1, F.lit(1))
            return (marked - k).cast("double") * (drawn - k) / ((k + 1).cast("double") * free)

        total = F.aggregate(
            steps,
            F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")),
            lambda a, k: F.struct((a["w"] * ratio(k)).alias("w"), (a["s"] + a["w"]).alias("s")),
            lambda a: a["s"],
        )
        below = F.aggregate(
            steps,
            F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"), (total * u).alias("t")),
            lambda a, k: F.struct(
                (a["w"] * ratio(k)).alias("w"),
                (a["s"] + a["w"]).alias("s"),
                (a["n"] + (a["s"] + a["w"] <= a["t"]).cast("long")).alias("n"),
                a["t"].alias("t"),
            ),
            lambda a: a["n"],
        )
        return F.least(end["low"] + below, F.greatest(end["low"], end["high"]))

    return _let(ends, quantile)


def _left_half(node: Column, counts: Column, pool: Column, drawn: Column) -> Column:
    """Counts per source of the left child: draws source by source from what is left."""
    start = F.struct(
        pool.alias("pool"), drawn.alias("drawn"), F.lit(0).alias("i"), F.array().cast("array<long>").alias("out")
    )

    def draw(a: Column, own: Column) -> Column:
        u = _uniform(F.lit(SEED), node, a["i"])
        return _let(
            hypergeometric(u, a["pool"], own, a["drawn"]),
            lambda x: F.struct(
                (a["pool"] - own).alias("pool"),
                (a["drawn"] - x).alias("drawn"),
                (a["i"] + 1).alias("i"),
                F.array_append(a["out"], x).alias("out"),
            ),
        )

    return F.aggregate(counts, start, draw, lambda a: a["out"])


def split_quotas(quotas: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(place int, shard int, blocks long)`` from ``(place, quota)``, places from 0.

    ``shards`` is a power of two.  A node holds a row with the counts of all sources, so
    the tree has one row for each node, whatever the number of documents.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    ordered = F.sort_array(F.collect_list(F.struct("place", "quota")))
    nodes = quotas.agg(F.transform(ordered, lambda x: x["quota"]).alias("counts")).select(
        F.lit(1).cast("long").alias("node"), "counts", F.lit(0).alias("first"),
        F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("pool"),
    )
    nodes = nodes.withColumn("all", F.col("pool"))
    width = shards
    while width > 1:
        width //= 2
        upto = lambda at: F.floor(at.cast("double") * F.col("all") / shards)
        drawn = upto(F.col("first") + width) - upto(F.col("first"))
        split = nodes.withColumn("drawn", drawn).withColumn(
            "left", _left_half(F.col("node"), F.col("counts"), F.col("pool"), F.col("drawn"))
        )
        children = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts"), F.col("first"), F.col("drawn").alias("pool")),
            F.struct(
                (F.col("node") * 2 + 1).alias("node"),
                F.zip_with("counts", "left", lambda a, b: a - b).alias("counts"),
                (F.col("first") + width).alias("first"),
                (F.col("pool") - F.col("drawn")).alias("pool"),
            ),
        )
        nodes = split.select(F.explode(children).alias("c"), "all").select("c.*", "all")
    return nodes.select(F.col("first").alias("shard"), F.posexplode("counts").alias("place", "blocks"))


def mixing_plan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    row: str | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, pieces``.

    ``pieces`` is an array of ``(shard, rank, epoch, start, words)``: which words of the
    document the mix takes, once for each repetition, the shard that gets them, and their
    place in the shard's local shuffle.  No word is taken more than ``most`` times.

    Null texts and texts of white space have size 0 and no pieces.  Null is a source of
    its own, after all others.  Null ids are ids like others; repeated rows are rows of
    their own.  Very long texts span many blocks.  An empty table gives no rows.  A
    source has fewer than 998,244,353 blocks.  ``row`` names a column that identifies
    rows and is passed through.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    passed = [] if row is None else [F.col(row).alias("row_no")]
    sized = materialize(
        docs.select(*passed, F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size")),
        "sizes",
    )
    table = targets(sized, weights, most)
    blocks = F.ceil(F.col("source_size") / block_words)
    epochs = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(most))
    rest = F.least(F.round((F.col("target") - epochs * F.col("source_size")) / block_words).cast("long"), F.col("blocks"))
    quota = F.least(epochs * F.col("blocks") + rest, F.lit(most) * F.col("blocks"))
    table = materialize(table.withColumn("blocks", blocks).withColumn("quota", quota), "quotas")
    leaves = split_quotas(table.select("place", "quota"), shards)
    by_shard = W.partitionBy("place").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = leaves.withColumn("begin", F.coalesce(F.sum("blocks").over(by_shard), F.lit(0)))
    offsets = offsets.groupBy("place").agg(F.sort_array(F.collect_list("begin")).alias("begins"))
    buckets = F.greatest(F.ceil(F.col("n_docs") / BUCKET_ROWS), F.lit(1))
    table = materialize(table.join(offsets, "place").withColumn("buckets", buckets), "tree")

    held = table.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64 + 8 * shards)).first()[0] or 0
    known = table.withColumnRenamed("source", "of") if held > BROADCAST_BYTES else F.broadcast(table.withColumnRenamed("source", "of"))
    mixed = F.xxhash64(F.lit(SEED), "doc_id")
    rows = sized.withColumn("mixed", mixed).join(known, F.col("source").eqNullSafe(F.col("of")))
    bucket = F.floor(F.pmod("mixed", F.lit(1 << 40)) / float(1 << 40) * F.col("buckets"))
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("place", "bucket").agg(F.sum("size").alias("words"))
    so_far = W.partitionBy("place").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("place", "bucket", F.coalesce(F.sum("words").over(so_far), F.lit(0)).alias("base"))
    tie = ["mixed", "doc_id", "size"] + (["row_no"] if passed else [])
    inside = W.partitionBy("place", "bucket").orderBy(*tie).rowsBetween(W.unboundedPreceding, -1)
    begun = rows.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["place", "bucket"])
    begun = begun.withColumn("begin", F.col("base") + F.col("local"))

    width = F.lit(block_words).cast("long")
    first, last = F.floor(F.col("begin") / width), F.floor((F.col("begin") + F.col("size") - 1) / width)
    steps = F.array(*(F.lit(s).cast("long") for s in STEPS))

    def piece(epoch: Column, block: Column) -> Column:
        """The block's part of the document, if the epoch takes it.  An epoch takes a range of
        the keyed stream, all of it but in the last, so documents stay whole but for the ends;
        its blocks are dealt in an affine permutation."""
        n = F.col("blocks")
        left = F.least(n, F.col("quota") - epoch * n)
        shift = F.pmod(F.xxhash64(F.lit(SEED), "place", epoch), n)
        step = F.element_at(steps, (epoch % len(STEPS) + 1).cast("int"))
        at = (block + shift) % n
        start = F.greatest(block * width, F.col("begin"))
        end = F.least((block + 1) * width, F.col("begin") + F.col("size"))
        return F.when(at < left, _let(
            epoch * n + (at * step + shift) % F.greatest(left, F.lit(1)),
            lambda p: F.struct(
                (F.size(F.filter("begins", lambda b: b <= p)) - 1).alias("shard"),
                F.xxhash64(F.lit(SEED), "place", p).alias("rank"),
                epoch.cast("int").alias("epoch"),
                (start - F.col("begin")).alias("start"),
                (end - start).alias("words"),
            ),
        ))

    every = F.flatten(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")),
            lambda e: F.transform(F.sequence(first, last), lambda b: piece(e, b)),
        )
    )
    pieces = F.when(F.col("size") > 0, F.filter(every, lambda x: x.isNotNull()))
    kind = "array<struct<shard:int,rank:bigint,epoch:int,start:bigint,words:bigint>>"
    return begun.select(
        *(["row_no"] if passed else []), "doc_id", "source", "size", "source_size", "target",
        F.coalesce(pieces, F.array()).cast(kind).alias("pieces"),
    )


def taken_words(pieces: str = "pieces") -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + p["words"])


def adjacent_runs(pieces: str = "pieces") -> Column:
    """The pieces of an epoch that stand next to each other as one, with the shard and rank of the first."""
    placed = F.array_sort(F.transform(pieces, lambda p: F.struct(p["epoch"].alias("epoch"), p["start"].alias("start"), p["words"].alias("words"), p["shard"].alias("shard"), p["rank"].alias("rank"))))

    def runs(own: Column) -> Column:
        def begins(i: Column) -> Column:
            was, now = F.get(own, i - 1), F.get(own, i)
            return (i == 0) | (was["epoch"] != now["epoch"]) | (was["start"] + was["words"] != now["start"])

        first = F.filter(F.sequence(F.lit(0), F.size(own) - 1), begins)
        return _let(first, lambda at: F.transform(at, lambda i, k: run(own, at, i, k)))

    def run(own: Column, at: Column, i: Column, k: Column) -> Column:
        head, last = F.get(own, i), F.get(own, F.coalesce(F.get(at, k + 1), F.size(own)) - 1)
        words = last["start"] + last["words"] - head["start"]
        return F.struct(head["shard"].alias("shard"), head["rank"].alias("rank"), head["epoch"].alias("epoch"), head["start"].alias("start"), words.alias("words"))

    return F.when(F.size(pieces) > 0, _let(placed, runs))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix as documents: a row of all columns for each run of adjacent words that an epoch
    takes of a document, with those words as its text (and ``n_chars``, if there is one).

    An epoch that takes all of a document takes it whole, white space included; in a
    source's last epoch the documents at the ends of the range are cut.  A run goes to the
    shard of its first block.  Rows come shard by shard, in the order of the shard's local
    shuffle.  Nulls, empty, long and repeated texts, clashing names and empty tables as in
    ``mixing_plan``.
    """
    own = materialize(docs.select(F.monotonically_increasing_id().alias("row_no"), F.struct("*").alias("doc")), "rows")
    narrow = own.select("row_no", *(F.col("doc")[c].alias(n) for c, n in ((doc_id, "id"), (text, "body"), (source, "source"))))
    plan = mixing_plan(narrow, "id", "body", "source", row="row_no", **how).where(F.size("pieces") > 0)
    taken = materialize(plan.select("row_no", "size", F.explode(adjacent_runs()).alias("run")), "runs")
    body = F.col("doc")[text]
    words = F.regexp_extract_all(body, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, (F.col("run.start") + 1).cast("int"), F.col("run.words").cast("int")), "")
    rows = own.join(taken, "row_no")
    out = rows.select("run.shard", "run.rank", "doc", F.when(F.col("run.words") == F.col("size"), body).otherwise(cut).alias("cut"))
    doc = F.col("doc").withField(text, F.col("cut"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.length("cut").cast(docs.schema["n_chars"].dataType))
    # ranks are hashes, so their ranges are known and nothing is sampled
    shards = how.get("shards", SHARDS)
    each = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    part = F.col("shard") * each + F.least(F.floor((F.col("rank") / float(1 << 64) + 0.5) * each), F.lit(each - 1)).cast("int")
    dealt = out.select("shard", "rank", doc.alias("doc")).repartitionById(shards * each, part).sortWithinPartitions("shard", "rank")
    return dealt.select("doc.*")
