"""Retrieval: vector and keyword search, ranking metrics and their means."""

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlode.functions.basic import bind, count_of, strip
from paperlode.operators.ranks import broadcast_limit, top_rows
from paperlode.operators.vector_balls import PART, SCORE_DIGITS, Profile, TopK

METRICS = ["hit_rate", "mrr", "precision", "recall", "f1", "ndcg", "average_precision"]

# --- search text -------------------------------------------------------------------------------


def search_text(df: DataFrame, fields: list[str] | None = None, name: str = "search_text") -> DataFrame:
    """"key: value" over sorted keys; blank values and null are left out."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def value(c: Column, kind) -> Column:
        kind_name = kind.typeName()
        if kind_name == "struct":
            return entries({f.name: (c[f.name], f.dataType) for f in kind.fields})
        if kind_name == "array":
            return F.array_join(F.transform(c, lambda x: F.coalesce(value(x, kind.elementType), F.lit(""))), " ")
        if kind_name == "map":
            pairs = F.array_sort(F.map_entries(c))
            return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " ")
        return c.cast("string")

    def entries(members: dict) -> Column:
        parts = []
        for key in sorted(members):
            shown = value(*members[key])
            parts.append(F.when(F.coalesce(shown, F.lit("")) != "", F.concat(F.lit(key + ": "), shown)))
        return F.concat_ws(" ", *parts)

    chosen = fields or df.columns
    return df.withColumn(name, entries({c: (F.col(f"`{c}`"), kinds[c]) for c in chosen}))


def with_instruction(query: Column, instruction: Column) -> Column:
    return F.concat_ws("\n\n", F.when(instruction != "", instruction), query)


# --- vector search -----------------------------------------------------------------------------


def _rows(vectors: pd.Series, unit: bool) -> np.ndarray:
    """Vectors as rows of one matrix, of unit length if asked; zero vectors stay zero."""
    matrix = np.stack(vectors.to_numpy()).astype(np.float64)
    if unit:
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix /= np.where(lengths == 0, 1.0, lengths)
    return matrix


class _Sent:
    """Queries that every task holds: their ids and their matrix."""

    def __init__(self, queries: DataFrame, query: str, vector: str, unit: bool):
        rows = queries.select(query, vector).toPandas()
        matrix = _rows(rows[vector], unit) if len(rows) else np.zeros((0, 1))
        self.ids = rows[query].to_list()
        self._held = queries.sparkSession.sparkContext.broadcast(matrix)

    @property
    def matrix(self) -> np.ndarray:
        return self._held.value


def _sent(queries: DataFrame, query: str, vector: str, unit: bool) -> _Sent | int:
    """The queries, if their counted bytes are within the session's limit for broadcasts; else these bytes."""
    n, dim = queries.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    held = n * (dim or 1) * 8
    return _Sent(queries, query, vector, unit) if held <= broadcast_limit(queries.sparkSession) else held


#: Bytes of queries a cell of :func:`_cells` holds at most.
CELL_BYTES = 64 * 2**20


def _cells(queries: DataFrame, cands: DataFrame, query: str, cand: str, vector: str, held: int) -> DataFrame:
    """Both tables dealt over a grid, a task a cell: (cell, is_cand, query, cand, vector), the queries of a cell first.

    For query sides above the limit for broadcasts. A row of cells has a group of queries, a column a group of
    candidates; every query meets every candidate in one cell. With t cells the vectors are copied about sqrt(t) times,
    however many there are; only groups of queries above ``CELL_BYTES`` are made smaller, with more rows of cells.
    """
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(math.isqrt(tasks), -(-held // CELL_BYTES))
    columns = max(1, tasks // groups)
    vector_type = queries.schema[vector].dataType
    if vector_type != cands.schema[vector].dataType:
        vector_type = "array<double>"

    def dealt(df: DataFrame, key: str, cells: Callable[[Column], Column], parts: int, is_cand: bool) -> DataFrame:
        own = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        # Ids travel in arrays of one or none: a column with nulls would turn whole numbers into floating-point ones.
        none = {n: F.array().cast(T.ArrayType(d.schema[c].dataType)) for n, d, c in (("query", queries, query), ("cand", cands, cand))}
        ids = [c.alias(n) for n, c in (none | {"cand" if is_cand else "query": F.array(F.col(key))}).items()]
        return df.select(F.explode(cells(own)).alias("cell"), F.lit(is_cand).alias("is_cand"), *ids, F.col(vector).cast(vector_type).alias("vector"))

    left = dealt(queries, query, lambda own: F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: own * columns + j), groups, False)
    right = dealt(cands, cand, lambda own: F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda i: i * columns + own), columns, True)
    met = left.unionByName(right).repartitionById(groups * columns, "cell")
    return met.sortWithinPartitions("cell", "is_cand")


def _by_cell(batches: Iterator[pd.DataFrame], unit: bool, start: Callable, add: Callable) -> Iterator:
    """What ``start(query ids, matrix)`` makes for each cell, after ``add`` was called for each batch of its candidates."""
    cell, ids, rows, found = None, [], [], None
    for pdf in batches:
        for number, part in pdf.groupby("cell"):
            if number != cell:
                if found is not None:
                    yield ids, found
                cell, ids, rows, found = number, [], [], None
            own = part[~part["is_cand"]]
            if len(own):
                ids += [x[0] for x in own["query"]]
                rows.append(_rows(own["vector"], unit))
            met = part[part["is_cand"]]
            if len(met) and ids:
                if found is None:
                    found = start(np.concatenate(rows))
                add(found, np.asarray([x[0] for x in met["cand"]]), _rows(met["vector"], unit))
    if found is not None:
        yield ids, found


def cosine_top_k(
    queries: DataFrame,
    cands: DataFrame,
    k: int,
    query: str = "query_id",
    cand: str = "cand_id",
    vector: str = "vector",
    size: int = 1024,
    inner: bool = False,
) -> DataFrame:
    """Best ``k`` candidates of every query by cosine, ties by candidate id: (query, cand, score, rank).

    ``inner`` ranks by inner product instead, as a flat index does; on unit vectors both orders agree. Queries
    within the session's limit for broadcasts go to every task, which reads its candidates where they lie, leaves out
    the parts that can't enter a query's best ``k`` (:mod:`paperlode.operators.vector_balls`) and sends on its own best
    ``k`` only. More queries than that meet the candidates in the cells of a grid, and each cell
    sends the best ``k`` of its queries over all its candidates.
    """
    query_type = queries.schema[query].dataType.simpleString()
    cand_type = cands.schema[cand].dataType.simpleString()
    held = _sent(queries, query, vector, not inner)

    def hits_of(ids: list, found: TopK) -> Iterator[pd.DataFrame]:
        names = np.empty(len(ids), dtype=object)
        names[:] = ids
        for q, c, scores in found.hits():
            yield pd.DataFrame({query: names[q], cand: c, "score": scores})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from hits_of(held.ids, _searched(held, batches, k, cand, vector, size, not inner))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, found in _by_cell(batches, not inner, lambda q: TopK(q, k, min(size, PART)), TopK.add):
            yield from hits_of(ids, found)

    hits = f"`{query}` {query_type}, `{cand}` {cand_type}, score DOUBLE"
    if isinstance(held, _Sent):
        partial = cands.select(cand, vector).mapInPandas(search, hits)
    else:
        partial = _cells(queries, cands, query, cand, vector, held).mapInPandas(best, hits)
    return top_rows(partial, [query], [F.col("score").desc(), F.col(cand)], k)


def _searched(held: _Sent, batches: Iterator[pd.DataFrame], k: int, cand: str, vector: str, size: int, unit: bool) -> TopK:
    found = TopK(held.matrix, k, min(size, PART))
    for pdf in batches:
        if len(pdf) and held.ids:
            found.add(np.asarray(pdf[cand].to_list()), _rows(pdf[vector], unit))
    return found


def met_share(
    queries: DataFrame, cands: DataFrame, k: int, query: str = "query_id", cand: str = "cand_id", vector: str = "vector", size: int = 1024,
    inner: bool = False,
) -> DataFrame:
    """What :func:`cosine_top_k` costs on these tables: (pairs, met), met being the pairs whose product is taken."""
    held = _sent(queries, query, vector, not inner)
    if not isinstance(held, _Sent):
        raise ValueError("queries above the limit for broadcasts meet all candidates")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = _searched(held, batches, k, cand, vector, size, not inner)
        yield pd.DataFrame({"pairs": [found.pairs], "met": [found.met]})

    rows = cands.select(cand, vector).mapInPandas(count, "pairs LONG, met LONG")
    return rows.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("met"), F.lit(0)).alias("met"))


def similarity_profile(
    queries: DataFrame, cands: DataFrame, at_least: float, query: str = "query_id", cand: str = "cand_id", vector: str = "vector", size: int = 1024
) -> DataFrame:
    """Every query against every candidate, folded per query: compared, similar and best score.

    The pairs exist only inside a block product; rows leave it already summed. Queries travel as in :func:`cosine_top_k`;
    parts of the candidates that lie wholly on one side of ``at_least`` and can't raise the best score are only counted.
    """
    query_type = queries.schema[query].dataType.simpleString()
    held = _sent(queries, query, vector, True)

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Profile(held.matrix, at_least, min(size, PART))
        for pdf in batches:
            if len(pdf) and held.ids:
                found.add(_rows(pdf[vector], True))
        met = found.compared > 0
        yield pd.DataFrame({query: held.ids, "compared": found.compared, "similar": found.similar, "best": found.best})[met]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def add(found: Profile, _: np.ndarray, matrix: np.ndarray) -> None:
            found.add(matrix)

        for ids, found in _by_cell(batches, True, lambda q: Profile(q, at_least, min(size, PART)), add):
            yield pd.DataFrame({query: ids, "compared": found.compared, "similar": found.similar, "best": found.best})

    sums = f"`{query}` {query_type}, compared LONG, similar LONG, best DOUBLE"
    if isinstance(held, _Sent):
        partial = cands.select(vector).mapInPandas(profile, sums)
    else:
        partial = _cells(queries, cands, query, cand, vector, held).mapInPandas(fold, sums)
    return partial.groupBy(query).agg(
        F.sum("compared").alias("compared"), F.sum("similar").alias("similar"), F.max("best").alias("best")
    )


# --- keyword search ----------------------------------------------------------------------------


def latest_records(records: DataFrame, limit: int = 50, time: str = "Timestamp", tie: list[str] | None = None) -> DataFrame:
    return records.orderBy(F.col(time).desc(), *(tie or [])).limit(limit)


def keyword_search(
    records: DataFrame, query: str, limit: int = 50, fields: list[str] | None = None, tie: list[str] | None = None
) -> DataFrame:
    """Records by the number of times the query words occur in their fields; no words gives the latest."""
    tokens = [t.lower() for t in (query or "").split()]
    if not tokens:
        return latest_records(records, limit, tie=tie)
    names = fields or ["Paper Link", "Dataset Link", "Dataset Description"]
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names]))
    score = bind(text, lambda t: reduce(lambda a, b: a + b, [count_of(t, F.lit(w)) for w in tokens]))
    # Matches sort before the rest, so the cut may come first and the score is computed once.
    best = records.withColumn("score", score).orderBy(F.col("score").desc(), *(tie or [])).limit(limit)
    return best.filter("score > 0")


def result_columns(df: DataFrame, with_score: bool = True) -> DataFrame:
    """Field names of a search answer."""
    names = {
        "Paper Link": "paper_link", "Dataset Link": "dataset_link",
        "Dataset Description": "description", "Timestamp": "timestamp",
    }
    score = [F.col("score")] if with_score else []
    return df.select(*score, *[F.col(f"`{a}`").alias(b) for a, b in names.items()])


def find_by_link(records: DataFrame, link: str, column: str = "Dataset Link", order: list[Column] | None = None) -> DataFrame:
    """The first record with a link: by ``order``, the record's position, or else by all its columns."""
    by = order or [F.col(f"`{c}`") for c in records.columns]
    return records.filter(F.col(f"`{column}`") == link).orderBy(*by).limit(1)


# --- relevance and metrics ---------------------------------------------------------------------

_LINKS = "paper_link STRING, dataset_link STRING, link STRING, positives STRING"


def _string_or_list(c: Column) -> Column:
    """A plain string as a list of one; a JSON list as its strings."""
    listed = F.from_json(c, "ARRAY<STRING>")
    return F.when(strip(c).startswith("["), listed).otherwise(F.array(c))


def _links_of(c: Column) -> Column:
    parsed = F.from_json(c, _LINKS)
    single = F.array(parsed["paper_link"], parsed["dataset_link"], parsed["link"])
    many = _string_or_list(F.coalesce(parsed["positives"], F.lit("")))
    return F.when(strip(F.coalesce(c, F.lit(""))).startswith("{"), F.concat(single, many)).otherwise(
        F.array().cast("array<string>")
    )


def relevant_links(ground_truth: Column, meta: Column, metadata: Column, positives: Column) -> Column:
    """Distinct relevant links of a query; every field is a JSON or plain string and may be null."""
    empty = F.array().cast("array<string>")
    parts = [F.coalesce(_links_of(c), empty) for c in (ground_truth, meta, metadata)]
    parts.append(F.coalesce(_string_or_list(F.coalesce(positives, F.lit(""))), empty))
    links = F.transform(F.concat(*parts), lambda x: strip(F.coalesce(x, F.lit(""))))
    return F.array_distinct(F.filter(links, lambda x: x != ""))


def mark_hits(results: DataFrame, relevant: DataFrame, query: str = "query_id", link: str = "link") -> DataFrame:
    """Add ``hit`` 1/0 to ranked results."""
    known = relevant.select(query, link).distinct().withColumn("hit", F.lit(1))
    return results.join(known, [query, link], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def ranking_metrics(
    results: DataFrame,
    relevant: DataFrame,
    ks: list[int],
    query: str = "query_id",
    link: str = "link",
    distinct_links: bool = False,
) -> DataFrame:
    """Metrics of every query with known answers at each k, in one pass over the results.

    ``results`` has query, rank from 1 and link. Queries without results score 0. Repeated links count
    as several hits unless ``distinct_links`` keeps only their best rank.
    """
    if distinct_links:
        results = results.groupBy(query, link).agg(F.min("rank").alias("rank"))
    truth = relevant.select(query, link).distinct().groupBy(query).agg(F.count(F.lit(1)).alias("n_relevant"))
    top = mark_hits(results.filter(F.col("rank") <= max(ks)), relevant, query, link)
    so_far = F.sum("hit").over(Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    counted = top.withColumn("hits_so_far", so_far)
    rank, hit = F.col("rank"), F.col("hit")

    def sums(k: int) -> Column:
        inside = (rank <= k) & (hit == 1)
        return F.struct(
            F.count_if(inside).alias("hits"),
            F.min(F.when(inside, rank)).alias("first"),
            F.coalesce(F.sum(F.when(inside, 1.0 / F.log2(rank + 1.0))), F.lit(0.0)).alias("dcg"),
            F.coalesce(F.sum(F.when(inside, F.col("hits_so_far") / rank)), F.lit(0.0)).alias("running"),
        ).alias(f"at_{k}")

    folded = truth.join(counted.groupBy(query).agg(*[sums(k) for k in ks]), query, "left")
    ideal = {0: 0.0}
    for i in range(1, max(ks) + 1):
        ideal[i] = ideal[i - 1] + 1.0 / float(np.log2(i + 1))

    def at(k: int) -> Column:
        s = F.col(f"at_{k}")
        hits = F.coalesce(s["hits"], F.lit(0))
        bound = F.least("n_relevant", F.lit(k))
        precision, recall = hits / F.lit(float(k)), hits / bound
        best = F.element_at(F.array(*[F.lit(ideal[i]) for i in range(1, k + 1)]), bound.cast("int"))
        values = {
            "hit_rate": (hits > 0).cast("double"),
            "mrr": F.coalesce(1.0 / s["first"], F.lit(0.0)),
            "precision": precision,
            "recall": recall,
            "f1": F.when(hits > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0),
            "ndcg": F.coalesce(s["dcg"], F.lit(0.0)) / best,
            "average_precision": F.coalesce(s["running"], F.lit(0.0)) / bound,
        }
        return F.struct(F.lit(k).alias("k"), *[values[m].alias(m) for m in METRICS])

    return folded.select(query, F.explode(F.array(*[at(k) for k in ks])).alias("m")).select(query, "m.*")


def long_metrics(metrics: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, k, metric, value) rows."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return metrics.select(query, "k", F.explode(pairs).alias("p")).select(query, "k", "p.*")


def mean_metrics(metrics: DataFrame, query: str = "query_id") -> DataFrame:
    """Mean, population deviation and number of valid queries per metric and k."""
    return long_metrics(metrics, query).groupBy("metric", "k").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("num_valid_queries")
    )
