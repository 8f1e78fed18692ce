"""Mixing sources to target weights: exact block quotas, split down a tree of output shards.

Targets. Sources in order of their names get the weights in turn and share ``percent`` of all words. No source
gives more than ``max_repeat`` times its size; what it cannot give is shared by the others by weight.

Blocks. The documents of a source lie in a random but repeatable order on one line of words. An epoch takes a
prefix of that line: the first epoch the whole line or what the target asks for, the next one what is left. The
taken words of a source are its target, rounded; a document at the end of a prefix is cut. Prefixes are cut into
blocks of ``block_words`` words.

Splitting tree. The quotas of all sources start at the root. A node gives half of its blocks to its left child;
how many of each source is a multivariate hypergeometric draw, made source by source by inversion around the mode.
The right child gets the rest, so quotas stay exact. A leaf is an output shard. Along a source, the shards take
consecutive runs of its permuted blocks: all draws are disjoint, and every block is drawn once. In a shard, pieces
are ordered by a hash. :func:`shards` gives the texts of the shards in that order; the counts per document come from
the pieces in the shards.

Everything is a DataFrame expression; no Python runs on the executors. The tables of sources and tree nodes are
small: one row per source, and one row per shard with a number for each source.

Cases: null text has size 0 and is taken 0 times; null source is a source of its own behind all others; null ids
are carried through; repeated rows are separate documents; all sizes 0 or an empty table: nothing is taken; other
columns are ignored. Reruns over the same rows agree.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.functions.basic import bind
from paperlode.llm.tables import Columns, fixed, word_count
from paperlode.operators.ranks import running_total

WEIGHTS = (3, 1, 2)
PERCENT = 150
MAX_REPEAT = 2
BLOCK_WORDS = 1024
SHARD_BLOCKS = 4096
MIN_SHARDS = 8


def _next_prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


#: Primes beyond any number of blocks of a source; a source steps through its blocks by one of them.
STEPS = tuple(_next_prime(1_000_000_007 + 61_803_399 * i) for i in range(16))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(doc_id, source, text_hash, size, h), written once; ``h`` is the random order of documents."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), word_count(text).alias("size"))
    return fixed(rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "text_hash")))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, k, source_size, weight, target) per source; k numbers the sources."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("k", (F.row_number().over(by_name) - 1).cast("bigint"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("source_size") * max_repeat)
    # Sources by the level at which they run dry; those in front of the final level give all they can.
    dry = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before, every = dry.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    shared = sources.withColumns({
        "rest": F.sum("source_size").over(every) * (percent / 100) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    }).withColumn("is_open", F.col("rest") * F.col("weight") <= F.col("cap") * F.col("open"))
    first = Window.partitionBy()
    level = shared.withColumns({
        "level_rest": F.min_by(F.when(F.col("is_open"), F.col("rest")), F.when(F.col("is_open"), F.col("cap") / F.col("weight"))).over(first),
        "level_open": F.min_by(F.when(F.col("is_open"), F.col("open")), F.when(F.col("is_open"), F.col("cap") / F.col("weight"))).over(first),
    })
    fair = F.col("level_rest") * F.col("weight") / F.col("level_open")
    target = F.coalesce(F.least(fair, F.col("cap").cast("double")), F.col("cap").cast("double"))
    return level.select("source", "k", "source_size", "weight", target.alias("target"))


def _draw(total: Column, hits: Column, n: Column, u: Column) -> Column:
    """Hypergeometric draw: of ``n`` from ``total`` with ``hits`` good ones, by inversion from the mode outwards."""
    t, k, m = total.cast("double"), hits.cast("double"), n.cast("double")
    low, high = F.greatest(F.lit(0.0), m - (t - k)), F.least(m, k)
    mode = F.least(F.greatest(F.floor((m + 1) * (k + 1) / (t + 2)).cast("double"), low), high)
    spread = F.sqrt(F.greatest(m * k * (t - k) * (t - m) / (t * t * F.greatest(t - 1, F.lit(1.0))), F.lit(0.0)))
    wide = F.ceil(spread * 10 + 10).cast("double")
    up = F.least(high - mode, wide).cast("int")
    down = F.least(mode - low, wide).cast("int")

    def grow(x: Column) -> Column:  # weight of x + 1 over weight of x
        return (k - x) * (m - x) / ((x + 1) * (t - k - m + x + 1))

    def shrink(x: Column) -> Column:  # weight of x - 1 over weight of x
        return x * (t - k - m + x) / ((k - x + 1) * (m - x + 1))

    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
    right = F.aggregate(F.sequence(F.lit(0), up), start, lambda a, i: F.struct((a["w"] * grow(mode + i)).alias("w"), (a["s"] + a["w"]).alias("s")))["s"]
    below = F.when(down > 0, F.sequence(F.lit(0), F.greatest(down - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    first = F.struct(shrink(mode).alias("w"), F.lit(0.0).alias("s"))
    left = F.when(down > 0, F.aggregate(below, first, lambda a, i: F.struct((a["w"] * shrink(mode - i - 1)).alias("w"), (a["s"] + a["w"]).alias("s")))["s"]).otherwise(F.lit(0.0))

    def walk(r: Column, l: Column) -> Column:
        goal = u * (r + l)
        count = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(-1).alias("n"))
        steps_up = F.aggregate(F.sequence(F.lit(0), up), count, lambda a, i: F.struct(
            (a["w"] * grow(mode + i)).alias("w"), (a["s"] + a["w"]).alias("s"), (a["n"] + F.when(a["s"] <= goal, 1).otherwise(0)).alias("n")))["n"]
        count_down = F.struct(shrink(mode).alias("w"), r.alias("s"), F.lit(-1).alias("n"))
        steps_down = F.aggregate(below, count_down, lambda a, i: F.struct(
            (a["w"] * shrink(mode - i - 1)).alias("w"), (a["s"] + a["w"]).alias("s"), (a["n"] + F.when(a["s"] <= goal, 1).otherwise(0)).alias("n")))["n"]
        return F.when((goal <= r) | (down == 0), mode + F.greatest(steps_up, F.lit(0))).otherwise(mode - 1 - F.greatest(steps_down, F.lit(0)))

    drawn = F.get(F.transform(F.array(F.struct(right.alias("r"), left.alias("l"))), lambda x: walk(x["r"], x["l"])), F.lit(0))
    return F.when((n == 0) | (hits == 0), F.lit(0.0)).when(n == total, k).otherwise(drawn).cast("bigint")


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _source_draw(seed: int, level: int):
    """Step over the sources of a node: state (blocks left, draws left, draws so far)."""

    def step(a: Column, i: Column) -> Column:
        hits = F.get("q", i)
        x = _draw(a["t"], hits, a["n"], _uniform(F.lit(seed), F.lit(level), F.col("shard"), i))
        return F.get(F.transform(F.array(x), lambda d: F.struct(
            (a["t"] - hits).alias("t"), (a["n"] - d).alias("n"), F.concat(a["out"], F.array(d)).alias("out"))), F.lit(0))

    return step


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(shard, q) for 2**levels shards from one row with the array ``q`` of block quotas by source."""
    nodes = quotas.select(F.lit(0).cast("bigint").alias("shard"), "q")
    zero = F.lit(0).cast("bigint")
    for level in range(levels):
        total = F.aggregate("q", zero, lambda a, x: a + x)
        halved = nodes.withColumn("total", total)
        start = F.struct(F.col("total").alias("t"), F.floor(F.col("total") / 2).cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("out"))

        indexes = F.transform("q", lambda x, i: i)
        drawn = halved.withColumn("left", F.aggregate(indexes, start, _source_draw(seed, level))["out"])
        sides = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("q")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), F.zip_with("q", "left", lambda a, b: a - b).alias("q")),
        )
        nodes = drawn.select(F.explode(sides).alias("n")).select("n.shard", "n.q")
    return nodes


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    percent: int = PERCENT, max_repeat: int = MAX_REPEAT, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Two tables.

    Documents: (doc_id, text_hash, k, start, size, source_size, target), one row per input row.
    Pieces: (shard, place, doc_id, text_hash, k, start, size, epoch, block, first, words); ``words`` words of the document
    from word ``first`` on go to ``shard``, in the order of ``place``.
    """
    rows = sized(docs, id_col, text_col, source_col, seed)
    n = rows.count()
    bits = min(24, max(8, (n // 50_000).bit_length()))
    plan = fixed(targets(rows, weights, percent, max_repeat))
    lined = running_total(
        rows, ["source"], {"part": F.shiftrightunsigned("h", 64 - bits)}, [F.col("h"), F.col("doc_id"), F.col("size")], F.col("size"), "start"
    )
    asked = F.round("target").cast("bigint")
    epochs = [
        F.greatest(F.lit(0), F.least(F.col("asked") - e * F.col("source_size"), F.col("source_size"))).cast("bigint").alias(f"r{e}")
        for e in range(max_repeat)
    ]
    blocks_of = [F.ceil(F.col(f"r{e}") / block_words).cast("bigint").alias(f"n{e}") for e in range(max_repeat)]
    quota = plan.withColumn("asked", asked).select("*", *epochs).select("*", *blocks_of)
    quota = quota.withColumn("blocks", sum((F.col(f"n{e}") for e in range(max_repeat)), F.lit(0)).cast("bigint"))
    total = quota.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    levels = max(MIN_SHARDS.bit_length() - 1, (total // shard_blocks).bit_length())

    root = quota.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "blocks"))), lambda x: x["blocks"]).alias("q"))
    leaves = split_quotas(root, levels, seed).select("shard", F.posexplode("q").alias("k", "draws"))
    upto = Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = leaves.withColumn("from", F.coalesce(F.sum("draws").over(upto), F.lit(0))).filter("draws > 0")
    taken = runs.select(F.col("k").cast("bigint").alias("k"), "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("draws") - 1)).alias("draw"))

    placed = lined.alias("d").join(quota.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "doc_id", "text_hash", "k", "start", "size", "source_size", "target", "blocks", *[f"r{e}" for e in range(max_repeat)], *[f"n{e}" for e in range(max_repeat)]
    )
    placed = fixed(placed)
    end = F.col("start") + F.col("size")
    parts, offset = [], F.lit(0).cast("bigint")
    for e in range(max_repeat):
        parts.append(_cuts(e, F.least(end, F.col(f"r{e}")), offset, block_words))
        offset = offset + F.col(f"n{e}")
    pieces = placed.select("doc_id", "text_hash", "k", "start", "size", "blocks", F.explode(F.concat(*parts)).alias("p"))
    step = F.element_at(F.array(*[F.lit(p) for p in STEPS]), (F.pmod(F.xxhash64(F.lit(seed), F.lit("step"), "k"), F.lit(len(STEPS))) + 1).cast("int"))
    turned = F.pmod(F.col("p.number") % F.col("blocks") * (step % F.col("blocks")) + F.pmod(F.xxhash64(F.lit(seed), "k"), F.col("blocks")), F.col("blocks"))
    # One row per block: its size grows with the data, while the planner sees a few shards and would broadcast it.
    pieces = pieces.withColumn("draw", turned).join(taken.hint("merge"), ["k", "draw"]).select(
        "shard", F.xxhash64(F.lit(seed), "shard", "k", "draw", "start").alias("place"), "doc_id", "text_hash", "k", "start", "size",
        "p.epoch", "p.block", (F.col("p.a") - F.col("start")).alias("first"), (F.col("p.z") - F.col("p.a")).alias("words"),
    )
    return placed.select("doc_id", "text_hash", "k", "start", "size", "source_size", "target"), pieces


def _cuts(epoch: int, stop: Column, offset: Column, block_words: int) -> Column:
    """The parts of a document in the blocks of one epoch, as words [a, z) of the source's line."""

    def part(b: Column) -> Column:
        return F.struct(
            F.lit(epoch).alias("epoch"), b.cast("bigint").alias("block"), (b + offset).cast("bigint").alias("number"),
            F.greatest(b * block_words, F.col("start")).cast("bigint").alias("a"), F.least((b + 1) * block_words, stop).cast("bigint").alias("z"),
        )

    there = (F.col("size") > 0) & (F.col("start") < F.col(f"r{epoch}"))
    numbers = F.sequence(F.floor(F.col("start") / block_words), F.floor((stop - 1) / block_words))
    none = F.array().cast("array<struct<epoch:int,block:bigint,number:bigint,a:bigint,z:bigint>>")
    return F.when(there, F.transform(numbers, part)).otherwise(none)


def taken_words(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """Per document (doc_id, size, source_size, target, taken, n_shards, first_shard, first_place), from the shards' pieces.

    The first piece is the one that comes first in the order of shards and their places; null if nothing is taken.
    """
    first = F.min(F.struct("shard", "place"))
    sums = pieces.groupBy("k", "start").agg(
        F.sum("words").alias("taken"), F.size(F.collect_set("shard")).cast("bigint").alias("n_shards"),
        first["shard"].alias("first_shard"), first["place"].alias("first_place"),
    ).withColumn("some", F.lit(True))
    joined = documents.withColumn("some", F.col("size") > 0).join(sums, ["k", "start", "some"], "left")
    none = F.lit(0).cast("bigint")
    return joined.select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), F.coalesce("n_shards", none).alias("n_shards"),
        "first_shard", "first_place",
    )


_WORD_ENDS = "(?<=[ \\t\\n\\x0B\\f\\r])(?=[^ \\t\\n\\x0B\\f\\r])"


_BLANKS = " \t\n\x0b\f\r"


def _spaced_words(text: Column) -> Column:
    """The words of a text, each with the white space behind it."""
    return F.split(F.ltrim(text, F.lit(_BLANKS)), _WORD_ENDS)


def _joined(words: Column, first: Column, n: Column) -> Column:
    """``n`` words from word ``first`` on, with the white space between them as it is."""
    return F.rtrim(F.array_join(F.slice(words, (first + 1).cast("int"), n.cast("int")), ""), F.lit(_BLANKS))


def shards(docs: DataFrame, documents: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: (shard, place, k, epoch, block, doc_id, words, text), a row per piece, in the order of shard and place.

    ``documents`` and ``pieces`` are the tables of :func:`mix` over ``docs``. A piece is what one document
    has in one block; a shard's texts, read in the order of ``place``, are its shuffled share of the mix.
    """
    # All pieces of one input row, so the text is split once; their number is bounded by its length.
    parts = pieces.groupBy("doc_id", "text_hash", "k", "start").agg(
        F.array_agg(F.struct("shard", "place", "epoch", "block", "first", "words")).alias("pieces")
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    # Equal rows have equal words: one of them gives the text of the pieces of all.
    one = rows.dropDuplicates(["id", "hash"])
    met = one.join(parts, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")))
    texts = bind(_spaced_words(F.col("text")), lambda ws: F.transform("pieces", lambda p: _joined(ws, p["first"], p["words"])))
    cut = met.select("doc_id", "k", F.explode(F.arrays_zip("pieces", texts.alias("text"))).alias("p")).select(
        "p.pieces.shard", "p.pieces.place", "k", "p.pieces.epoch", "p.pieces.block", "doc_id", "p.pieces.words", "p.text",
    )
    return cut.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")


def apply(docs: DataFrame, documents: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents as the mix takes them, with all their columns: once per epoch, cut where the mix cuts them.

    ``documents`` and ``pieces`` are the tables of :func:`mix` over ``docs``.
    """
    # Rows that are equal in id and text are alike: they are numbered on both sides.
    alike = documents.select("doc_id", "text_hash", "k", "start", "size", F.row_number().over(
        Window.partitionBy("doc_id", "text_hash").orderBy("k", "start")).alias("__row"))
    sums = pieces.groupBy("k", "start", "epoch").agg(F.sum("words").alias("__words"))
    used = fixed(alike.filter("size > 0").join(sums, ["k", "start"]).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__row", "__words", F.col("size").alias("__size")
    ))
    mine = Columns(docs)
    named = mine.df.withColumns({"__key": mine[id_col], "__text_hash": F.xxhash64(mine[text_col].cast("string"))})
    repeats = used.filter("__row > 1").limit(1).count()
    number = F.row_number().over(Window.partitionBy("__key", "__text_hash").orderBy(F.lit(0))) if repeats else F.lit(1)
    named = named.withColumn("__number", number)
    on = F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")) & (F.col("__number") == F.col("__row"))
    cut = _joined(_spaced_words(mine[text_col].cast("string")), F.lit(0), F.col("__words"))
    text = F.when(F.col("__words") < F.col("__size"), cut).otherwise(mine[text_col])
    return mine.back(named.join(used, on).withColumn(mine.key(text_col), text))
