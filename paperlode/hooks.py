"""Extension points. Models stay outside; each hook has a deterministic default that runs offline."""

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.functions.basic import strip
from paperlode.functions.text import TOKEN_PATTERN, count_tokens

DEFAULT_CLUES = ["dataset", "corpus", "benchmark", "annotation", "collected", "release"]


def clue_probability(text: Column, clues: list[str] = DEFAULT_CLUES, bias: float = -1.0, weight: float = 1.0) -> Column:
    """Default scorer: a logistic of the number of clue words a text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.lit(0)
    for clue in clues:
        hits = hits + low.contains(clue).cast("int")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(bias) + hits * F.lit(weight))))


def batch_scorer(predict: Callable[[list[str]], list[float]], batch: int = 32) -> Callable[[Column], Column]:
    """Any batch model as a column function; the model is called per Arrow batch in slices."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            values: list[float] = []
            for i in range(0, len(series), batch):
                values += [float(v) for v in predict(series.iloc[i:i + batch].fillna("").tolist())]
            yield pd.Series(values, index=series.index)

    return score


def score_papers(papers: DataFrame, scorer: Callable[[Column], Column] = clue_probability) -> DataFrame:
    """Gate probability of title and abstract."""
    text = strip(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))))
    return papers.withColumn("gate_prob", scorer(text))


def tag_windows(members: DataFrame, scorer: Callable[[Column], Column] = clue_probability, threshold: float = 0.5) -> DataFrame:
    """Sentence probability inside each window (paper_name, window_id, gid, text)."""
    prob = scorer(F.col("text"))
    return members.withColumn("prob", prob).withColumn("label", (F.col("prob") >= threshold).cast("int"))


def window_scorer(predict: Callable[[list[list[str]]], list[list[float]]], batch: int = 16) -> Callable[[Column], Column]:
    """Any model that reads the sentences of a window together, as a function of their array; called in slices of windows."""

    @F.pandas_udf("array<double>")
    def score(windows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in windows:
            values: list[list[float]] = []
            for i in range(0, len(series), batch):
                values += [[float(v) for v in w] for w in predict([list(x) for x in series.iloc[i:i + batch]])]
            yield pd.Series(values, index=series.index)

    return score


def tag_whole_windows(members: DataFrame, scorer: Callable[[Column], Column], threshold: float = 0.5) -> DataFrame:
    """As :func:`tag_windows`, with a scorer from the array of a window's ordered sentences to one probability each.

    A window is bounded by its token budget, so its sentences fit one row.
    """
    ordered = members.groupBy("paper_name", "window_id").agg(F.array_sort(F.collect_list(F.struct("gid", "text"))).alias("s"))
    scored = ordered.withColumn("p", scorer(F.transform("s", lambda x: x["text"])))
    rows = scored.select("paper_name", "window_id", F.explode(F.arrays_zip("s", "p")).alias("r"))
    prob = F.col("r.p")
    return rows.select("paper_name", "window_id", "r.s.gid", "r.s.text", prob.alias("prob"), (prob >= threshold).cast("int").alias("label"))


def token_column(text: Column, counter: Callable[[Column], Column] = count_tokens) -> Column:
    return counter(text)


# --- trained default ---------------------------------------------------------------------------


def _tokens(column: str) -> RegexTokenizer:
    return RegexTokenizer(inputCol=column, outputCol="__words", pattern=TOKEN_PATTERN, gaps=False)


def train_gate(samples: DataFrame, features: int = 1 << 15, iterations: int = 20) -> PipelineModel:
    """Text classifier on (text, label): hashed terms and a logistic regression."""
    return Pipeline(stages=[
        _tokens("text"),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features),
        IDF(inputCol="__tf", outputCol="__features"),
        LogisticRegression(featuresCol="__features", labelCol="label", maxIter=iterations, regParam=0.01),
    ]).fit(samples)


def apply_gate(model: PipelineModel, samples: DataFrame) -> DataFrame:
    """Add gate_prob and predicted_label."""
    scored = model.transform(samples).withColumn("gate_prob", vector_to_array("probability")[1])
    return scored.withColumn("predicted_label", (F.col("gate_prob") >= 0.5).cast("int")).drop(
        "__words", "__tf", "__features", "rawPrediction", "probability", "prediction"
    )


# --- encoders ----------------------------------------------------------------------------------


class Encoder(Protocol):
    """What a retriever needs: vectors for texts. ``encode`` adds an array column."""

    name: str

    def encode(self, texts: DataFrame, text: str, vector: str) -> DataFrame: ...


class HashingEncoder:
    """Default encoder: hashed term counts of unit length."""

    def __init__(self, size: int = 256):
        self.name, self.size = f"hashing-{size}", size

    def encode(self, texts: DataFrame, text: str, vector: str = "vector") -> DataFrame:
        words = _tokens(text).transform(texts)
        counted = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=self.size).transform(words)
        unit = Normalizer(inputCol="__tf", outputCol="__unit").transform(counted)
        return unit.withColumn(vector, vector_to_array("__unit", "float32")).drop("__words", "__tf", "__unit")


class GivenVectors:
    """Vectors that are already stored: joined by key instead of computed."""

    def __init__(self, vectors: DataFrame, key: str, name: str = "given"):
        self.vectors, self.key, self.name = vectors, key, name

    def encode(self, texts: DataFrame, text: str, vector: str = "vector") -> DataFrame:
        return texts.join(self.vectors.select(self.key, vector), self.key)


class BatchEncoder:
    """Any batch model: a function from texts to vectors, called per Arrow batch in slices."""

    def __init__(self, name: str, predict: Callable[[list[str]], list], batch: int = 32):
        self.name, self.predict, self.batch = name, predict, batch

    def encode(self, texts: DataFrame, text: str, vector: str = "vector") -> DataFrame:
        predict, batch = self.predict, self.batch

        @F.pandas_udf("array<float>")
        def run(series: pd.Series) -> pd.Series:
            out: list = []
            for i in range(0, len(series), batch):
                out += [list(map(float, v)) for v in predict(series.iloc[i:i + batch].fillna("").tolist())]
            return pd.Series(out, index=series.index)

        return texts.withColumn(vector, run(F.col(text)))


ENCODERS: dict[str, Callable[..., Encoder]] = {
    "hashing": HashingEncoder, "given": GivenVectors, "batch": BatchEncoder,
}


def make_encoder(kind: str, *args, **kwargs) -> Encoder:
    if kind not in ENCODERS:
        raise ValueError(f"unknown encoder {kind!r}; known: {sorted(ENCODERS)}")
    return ENCODERS[kind](*args, **kwargs)


# --- external classifier -----------------------------------------------------------------------


def request_table(cands: DataFrame, keys: list[str], index: str, batch: int = 4) -> DataFrame:
    """Requests for an external classifier in batches of fixed size over a gap-free index."""
    return cands.withColumns({
        "batch_id": F.floor(F.col(index) / batch).cast("long"), "idx": (F.col(index) % batch).cast("int"),
    })
