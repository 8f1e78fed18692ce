"""URL filter: rules on host and path first, for the rest a logistic regression on hashed character n-grams.

Rules. A rule names a host and the start of a path; it fits the host and its subdomains. The longest rule that fits
decides. Rules are tried as expressions over one row; their number is that of a configuration.

Model. Character n-grams of host and path (with a mark in between) are hashed into ``BUCKETS`` features. The weights are
fitted by gradient descent on a small labelled URL table: one that the caller gives, or the table that
:func:`labelled_words` builds from two word lists. Training cost is that of this table; every row is scored. One
fitted weight per bucket, ``BUCKETS`` numbers in all, goes back into the scoring expression.

Everything is a DataFrame expression, training included; no Python runs on the executors.

Cases: null urls and urls without "://" have an empty host and path, no rule fits them, and the model judges them by
its intercept; without labelled rows of both kinds everything is allowed; repeated rows get equal results; an empty
table gives an empty result; other columns are ignored.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.llm.tables import fixed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of this job.
RULES = (
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
)
SIZES = (2, 3, 4)
BUCKETS = 2048
STEPS = 30
RATE = 10.0
DECAY = 1e-5

# The words of the labelled table, and the parts of a URL that say nothing.
JUNK = (
    "spam", "farm", "casino", "win", "adult", "porn", "xxx", "sex", "pills", "cheap", "viagra", "pharma", "bets", "free", "poker", "slots",
    "jackpot", "lottery", "gamble", "loan", "payday", "credit", "replica", "ads", "track", "tracker", "banner", "popup", "click", "bait",
    "malware", "phish", "warez", "crack", "keygen", "torrent", "escort", "dating", "nude", "cam", "hack", "scam", "fake", "rolex", "seo",
    "backlinks", "bitcoin", "profit", "miracle", "weightloss",
)
CLEAN = (
    "station", "nation", "weather", "library", "museum", "school", "science", "garden", "river", "mountain", "history", "letters", "nature",
    "ocean", "music", "theatre", "kitchen", "recipes", "health", "hospital", "journal", "archive", "university", "research", "physics",
    "chemistry", "biology", "forest", "harbour", "railway", "bridge", "village", "council", "parish", "tourism", "hotel", "bakery",
    "coffee", "books", "author", "poetry", "painting", "gallery", "camera", "photo", "film", "radio", "news", "daily", "evening", "north",
    "south", "western", "eastern", "union", "thread", "thorn", "shore", "ship", "sheep", "house", "home", "heat", "earth", "stone", "iron",
    "onion", "lion", "tiger", "otter", "heron", "robin", "finch", "sand", "island", "england", "ireland", "irish", "danish", "english",
    "german", "french", "spanish", "latin", "reading", "writing", "printing", "engine", "motor", "wheel", "action", "edition", "fiction",
    "tradition", "education", "nutrition", "auction", "mention", "motion", "potion", "ration", "thing", "nothing", "another", "other",
    "brother", "mother", "father", "leather", "feather", "those", "there", "where", "here", "answer", "question", "wisdom", "winter", "window",
    "wind", "wine", "spring", "space", "spoon", "sports", "farmers", "freedom", "camp", "campus", "address", "trade", "traditional", "clock",
)
SUBDOMAINS = ("", "www.", "m.", "blog.")
DOMAINS = ("example.com", "example.net", "example.org")
PATHS = ("/en/{n}", "/de/{n}/", "/fr/{n}.html", "/es/{n}", "/", "/en/{n}/", "")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: lower-case host behind the first "://", path up to a query or fragment; empty if there is none."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.substring(text, F.instr(text, "://") + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def features(host: Column, path: Column, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> Column:
    """Buckets of all n-grams, in order and with repeats."""
    text = F.concat(F.lit("^"), host, F.lit(" "), path, F.lit("$"))
    none = F.array().cast("array<int>")

    def grams(t: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.length(t) - n + 1)
        return F.when(F.length(t) >= n, F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(n), F.substring(t, i, F.lit(n))), F.lit(buckets)).cast("int"))).otherwise(none)

    return F.concat(*[grams(text, n) for n in sizes])


def _score(grams: Column, weights: list[float], intercept: float) -> Column:
    """Log odds of "block": the mean weight of the n-grams, scaled by the root of their number."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded into one constant
    total = F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.element_at(table, g + 1))
    return F.lit(float(intercept)) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    intercept: float

    def score(self, host: Column, path: Column) -> Column:
        return _score(features(host, path), list(self.weights), self.intercept)


def train(labelled: DataFrame, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Model | None:
    """Fit on (host, path, label) with label 1 for "block". Full-batch steps; each sums gradients by bucket in Spark.

    The table must be small: one step reads it once. The driver holds ``BUCKETS`` numbers.
    """
    rows = labelled.select("label", features(F.col("host"), F.col("path")).alias("g")).withColumn("scale", 1 / F.sqrt(F.size("g").cast("double")))
    rows = fixed(rows.coalesce(2))
    n, blocked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if blocked in (0, n):
        return None
    # Both labels weigh the same, however many rows they have.
    share = F.when(F.col("label") == 1, n / (2 * blocked)).otherwise(n / (2 * (n - blocked)))
    weights, intercept = [0.0] * BUCKETS, 0.0
    speed = [0.0] * (BUCKETS + 1)
    for _ in range(steps):
        score = _score(F.col("g"), weights, intercept)
        error = (1 / (1 + F.exp(-score)) - F.col("label")) * share
        graded = rows.select(F.round(error, 12).alias("e"), "scale", "g")
        ones = F.transform("g", lambda g: F.struct(g.alias("b"), (F.col("e") * F.col("scale")).alias("v")))
        every = F.concat(ones, F.array(F.struct(F.lit(-1).alias("b"), F.col("e").alias("v"))))
        # Sums of decimals do not depend on the order of rows, so reruns agree.
        sums = graded.select(F.explode(every).alias("x")).groupBy("x.b").agg(F.sum(F.col("x.v").cast("decimal(28,15)")).alias("s")).collect()
        gradient = [0.0] * (BUCKETS + 1)
        for b, s in sums:
            gradient[b] = float(s) / n  # bucket -1, the intercept, is the last one
        for b in range(BUCKETS):
            speed[b] = 0.9 * speed[b] - rate * (gradient[b] + decay * weights[b])
            weights[b] += speed[b]
        speed[BUCKETS] = 0.9 * speed[BUCKETS] - rate * gradient[BUCKETS]
        intercept += speed[BUCKETS]
    return Model(tuple(weights), intercept)


def labelled_words(spark: SparkSession, junk: tuple[str, ...] = JUNK, clean: tuple[str, ...] = CLEAN) -> DataFrame:
    """(host, path, label): each word with four endings, subdomains and paths that say nothing about the label."""
    rows = []
    for label, words in ((1, junk), (0, clean)):
        for k, word in enumerate(words):
            pair = words[(7 * k + 3) % len(words)]
            for j in range(4):
                name = (word, f"{word}-{pair}", word, f"{pair}{word}")[j]
                host = f"{SUBDOMAINS[(k + j) % len(SUBDOMAINS)]}{name}.{DOMAINS[(k + 2 * j) % len(DOMAINS)]}"
                path = PATHS[(k + j) % len(PATHS)].format(n=(37 * k + 11 * j) % 900 + 10, word=word)
                rows.append(F.struct(F.lit(host).alias("host"), F.lit(path).alias("path"), F.lit(label).alias("label")))
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def judge(pages: DataFrame, model: Model | None, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score): score is the model's log odds of "block", null without a model."""
    host, path = url_parts(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    scored = split.withColumn("r", best_rule(F.col("host"), F.col("path"), rules))
    score = F.when(F.col("r").isNull(), model.score(F.col("host"), F.col("path"))) if model else F.lit(None).cast("double")
    scored = scored.withColumn("score", score)
    own = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), "score")


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Train on ``labelled`` (host, path, label), by default on :func:`labelled_words`, and judge all pages."""
    table = labelled_words(pages.sparkSession) if labelled is None else labelled
    return judge(pages, train(table), rules, id_col, url_col)
