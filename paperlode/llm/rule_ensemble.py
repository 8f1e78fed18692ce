"""Quality classifier: a sparse ensemble of rules over statistics of a text.

1. Statistics. Shares and means that describe the shape of a text, each one a Spark expression; words of the text itself
   are no input, nor are ids, languages or sources.
2. Rules. A forest of shallow trees is grown on labelled statistics. Every path from a root to a node below it is a rule:
   a conjunction of "statistic <= t" and "statistic > t", with the tightest bound per statistic and side. Equal rules
   are kept once.
3. Weights. A logistic model with an L1 penalty is fitted to the rules' indicators. Rules of weight 0 go.
4. Score. What remains is compiled into one column expression: 1 / (1 + exp(-(b + sum of the weights of the rules that hold))).

Training rows are a sample of at most about ``max_rows`` distinct labelled rows (a documented bound; rows are taken by a
hash of their content, so a rerun takes the same ones). They are sorted into one partition, which makes trees and
weights repeatable. Statistics are computed for whole texts of all documents, once, and written as a narrow table; labels
are joined to that table and the score reads it.

Cases: null and empty texts, and texts without words, have statistics 0 and get the score those have; a null id is never
held out and never learned from; labels that are null or not 0 or 1 are ignored, a document with both labels counts
for both; repeated rows get equal scores and count once in training; without labelled rows of both kinds the score
is (1 + rows of label 1) / (2 + rows) for all; an empty table gives an empty result; other columns are ignored.
"""

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.llm.tables import fixed, word_list

MAX_ROWS = 20_000
TREES, DEPTH = 24, 3
PENALTY = 0.001
#: Steps and tolerance of the logistic fit.
STEPS, TOLERANCE = 100, 1e-3
HELD_OUT = (4, 2)
LIMIT = 0.7

#: Characters whose share of all characters is a statistic.
CHARACTERS = {
    "symbols": "#*$%&<>{}[]\\^~=+@_/", "bars": "|", "shouts": "!", "questions": "?", "stops": ".", "commas": ",;:", "digits": "0123456789",
    "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "vowels": "aeiou", "lines": "\n",
}
STATISTICS = [*CHARACTERS, "log_words", "word_length", "distinct", "repeats", "single", "long_words", "ends"]


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Statistics of a text (never null) and the array of its words."""
    chars, n = F.length(text), F.size(words)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")

    def words_with(test) -> Column:
        return share(F.size(F.filter(words, test)), n)

    def without(which: str) -> Column:
        return F.replace(text, F.lit(which), F.lit("")) if len(which) == 1 else F.regexp_replace(text, f"[{re.escape(which)}]+", "")

    out = {name: share(chars - F.length(without(which)), chars) for name, which in CHARACTERS.items()}
    out["log_words"] = F.log1p(n.cast("double"))
    out["word_length"] = share(chars, n)
    out["distinct"] = share(F.size(F.array_distinct(words)), n)
    out["repeats"] = words_with(lambda w, i: F.coalesce(w == F.get(words, i - 1), F.lit(False)))
    out["single"] = words_with(lambda w: F.length(w) == 1)
    out["long_words"] = words_with(lambda w: F.length(w) > 15)
    out["ends"] = F.when(F.rtrim(text).rlike("[.!?]$"), 1.0).otherwise(0.0)
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every row, written once."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    split = plain.withColumn("words", word_list(F.col("text")))
    made = statistics(F.col("text"), F.col("words"))
    return fixed(split.select("doc_id", *[made[s].alias(s) for s in STATISTICS]))


def held_out(doc_id: Column, parts: tuple[int, int] = HELD_OUT) -> Column:
    """Whether the CRC-32 of the decimal id leaves the held-out remainder."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts[0])) == parts[1], F.lit(False))


# --- rules ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, "<=" or ">", bound) that all hold, and what the rule adds to the score."""

    conditions: tuple[tuple[str, str, float], ...]
    weight: float = 0.0

    def holds(self) -> Column:
        parts = [F.col(name) <= F.lit(bound) if side == "<=" else F.col(name) > F.lit(bound) for name, side, bound in self.conditions]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def __str__(self) -> str:
        return " and ".join(f"{name} {side} {bound:.6g}" for name, side, bound in self.conditions) + f": {self.weight:+.3f}"


@dataclass(frozen=True)
class Ensemble:
    """Rules with weights, and a constant."""

    rules: tuple[Rule, ...]
    constant: float

    def score(self) -> Column:
        """The score as one expression over the columns of :data:`STATISTICS`."""
        total = F.lit(self.constant)
        for r in self.rules:
            total = total + F.when(r.holds(), F.lit(r.weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


_STEP = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)$")


def path_rules(tree: str, names: list[str]) -> list[tuple]:
    """Conditions of every path of a tree, given as the indented text that Spark prints for it."""
    out, stack = [], []
    for line in tree.splitlines():
        step = _STEP.match(line)
        if step:
            indent, feature, side, bound = len(step[1]), int(step[2]), step[3], float(step[4])
            stack = [s for s in stack if s[0] < indent] + [(indent, names[feature], side, bound)]
            tight: dict[tuple[str, str], float] = {}
            for _, name, which, b in stack:
                have = tight.get((name, which), b)
                tight[name, which] = min(have, b) if which == "<=" else max(have, b)
            out.append(tuple(sorted((name, which, b) for (name, which), b in tight.items())))
    return out


def training_rows(stats: DataFrame, labels: DataFrame, max_rows: int, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """Distinct labelled statistics outside the held-out part, thinned by a hash to about ``max_rows``, in one sorted partition."""
    known = labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("double").alias("label")).filter("label in (0.0, 1.0)").distinct()
    rows = stats.join(known, F.col("doc_id") == F.col("of")).filter(~held_out(F.col("doc_id"))).drop("of").distinct()
    rows = fixed(rows.withColumn("place", F.xxhash64(*[F.col(c) for c in ("doc_id", "label", *STATISTICS)])))
    n = rows.count()
    share = 1_000_000 if n <= max_rows else max_rows * 1_000_000 // n
    taken = rows.filter(F.pmod(F.col("place"), F.lit(1_000_000)) < share).drop("doc_id")
    return fixed(taken.coalesce(1).sortWithinPartitions("place", "label", *STATISTICS).drop("place"))


def train(
    stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY,
    label_col: str = "quality",
) -> Ensemble:
    """Grow trees, take their paths as rules, and give them sparse weights."""
    rows = training_rows(stats, labels, max_rows, label_col)
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        ones, n = seen.get(1.0, 0), sum(seen.values())
        return Ensemble((), math.log((ones + 1) / (n - ones + 1)))
    vectors = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    grower = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, subsamplingRate=0.7, featureSubsetStrategy="onethird", maxBins=64)
    paths = sorted({p for tree in grower.fit(vectors).trees for p in path_rules(tree.toDebugString, STATISTICS)})
    rules = [Rule(p) for p in paths]
    indicators = rows.select("label", array_to_vector(F.array(*[r.holds().cast("double") for r in rules])).alias("features"))
    fitted = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=STEPS, tol=TOLERANCE).fit(indicators)
    weights = [round(float(w), 6) for w in fitted.coefficients.toArray()]
    return Ensemble(tuple(Rule(r.conditions, w) for r, w in zip(rules, weights, strict=True) if w), round(float(fitted.intercept), 6))


def scored(stats: DataFrame, model: Ensemble, limit: float = LIMIT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of statistics."""
    rows = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= limit).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Train on the labelled documents outside the held-out part and score all documents."""
    stats = measured(docs, id_col, text_col)
    return scored(stats, train(stats, labels, **options))
