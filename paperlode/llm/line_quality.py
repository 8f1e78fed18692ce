"""Quality rules: base counts of a text, and line frequency across the documents of a host.

Line frequency. Lines are normalised (lower case, single blanks) and hashed. Per host the distinct documents with
a line are counted; documents of equal text are one document, so copies alone make no line frequent. Lines in more
than ``max_docs`` documents of their host are removed; the limit is the same for small and large hosts. A document is
depleted if fewer than ``min_words`` words or less than half of its words remain.

Lines meet the frequent ones by a join on (host, hash): by broadcast within counted rows and bytes, else by a shuffle of
written rows, whose hot lines Spark splits. What a document loses is added up per (id, text, host) and joined back, so no
array grows with a host.

Cases: null text has no words and no lines and fails the base rules; null host is a host of its own; null ids are
carried through; repeated rows get equal results; an empty table gives an empty result; long texts are handled in
time proportional to their length (sorting aside); other columns of the input are ignored.

Everything is a DataFrame expression; no Python runs on the executors.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.llm.tables import BLANKS, Columns, fixed, small, word_list

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
MAX_DOCS = 20


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: _without(line, BLANKS) != "")


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, "[ \\t\\n\\x0B\\f\\r]+", " ")))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur at least twice in the array."""
    hashes = F.when(
        F.size(words) >= window,
        F.transform(F.sequence(F.lit(1), F.size(words) - window + 1), lambda i: F.xxhash64(F.slice(words, i, window))),
    ).otherwise(F.array().cast("array<bigint>"))

    def of_hashes(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of_order(s: Column) -> Column:
            def tied(x: Column, k: Column) -> Column:
                before = F.get(s, k - 1)["h"] == x["h"]
                after = F.get(s, k + 1)["h"] == x["h"]
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

            places = F.sort_array(F.transform(F.filter(s, tied), lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            total = F.aggregate(
                places, start,
                lambda a, p: F.struct((p + window).alias("end"), (a["n"] + p + window - F.greatest(p, a["end"])).alias("n")),
            )
            return total["n"]

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(F.get(F.transform(F.array(ordered), of_order), F.lit(0)))

    return F.get(F.transform(F.array(hashes), of_hashes), F.lit(0)).cast("bigint")


def base_counts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per input row: ids, host, counts, and (hash, words) of each line; written once."""
    plain = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    split = plain.select(
        "doc_id", "host", F.xxhash64("text").alias("text_hash"), F.length(_without(F.col("text"), BLANKS)).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("bigint").alias("n_symbols"),
        word_list(F.col("text")).alias("words"), _lines(F.col("text")).alias("lines"),
    )
    return fixed(split.select(
        "doc_id", "host", "text_hash", F.size("words").cast("bigint").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.size(word_list(x)).alias("n"))).alias("lines"),
    ))


def frequent_lines(counted: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(of_host, line, docs): the hashes of lines in more than ``max_docs`` distinct documents of their host."""
    one = counted.select("host", "text_hash", F.array_distinct(F.col("lines.h")).alias("h")).dropDuplicates(["host", "text_hash"])
    often = one.select("host", F.explode("h").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs"))
    return often.filter(F.col("docs") > max_docs).select(F.col("host").alias("of_host"), F.col("h").alias("line"), "docs")


def _same_row(*names: str) -> Column:
    """Equality of id, text and host, where ids and hosts may be null."""
    i, t, h = names
    return F.col("doc_id").eqNullSafe(F.col(i)) & (F.col("text_hash") == F.col(t)) & F.col("host").eqNullSafe(F.col(h))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """One row per input row: doc_id, host, text_hash, the base counts, base_failed, removed_words, removed_lines, cut, kept.

    ``cut`` holds the hashes of the document's lines that go; ``kept`` is the verdict.
    """
    counted = base_counts(docs, id_col, text_col, host_col)
    found = small(frequent_lines(counted, max_docs).drop("docs"), 500_000)
    # Rows of one id, text and host are alike: their lines are looked up once.
    alike = counted.filter(F.size("lines") > 0).dropDuplicates(["doc_id", "text_hash", "host"])
    lines = alike.select("doc_id", "text_hash", "host", F.explode("lines").alias("x")).select("doc_id", "text_hash", "host", "x.h", "x.n")
    met = lines.join(found, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("h") == F.col("line")))
    losses = met.groupBy(F.col("doc_id").alias("i"), F.col("text_hash").alias("t"), F.col("host").alias("o")).agg(
        F.sum("n").alias("gone"), F.count(F.lit(1)).alias("gone_lines"), F.collect_set("h").alias("hashes")
    )
    joined = counted.drop("lines").join(small(losses, 500_000), _same_row("i", "t", "o"), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    zero = F.lit(0).cast("bigint")
    left = F.col("n_words") - F.coalesce("gone", zero)
    return joined.select(
        "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.coalesce("gone", zero).alias("removed_words"), F.coalesce("gone_lines", zero).alias("removed_lines"),
        F.coalesce("hashes", F.array().cast("array<bigint>")).alias("cut"), (~failed & (left >= MIN_WORDS) & (2 * left >= F.col("n_words"))).alias("kept"),
    )


def apply(docs: DataFrame, assessed: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The kept documents with all their columns, without the lines that are frequent on their host.

    Only rejects and documents that lose lines are looked up; a text without such lines stays as it is.
    """
    mine = Columns(docs)
    told = assessed.filter(~F.col("kept") | (F.size("cut") > 0)).dropDuplicates(["doc_id", "text_hash", "host"]).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("host").alias("__host"), F.col("cut").alias("__cut"), F.col("kept").alias("__kept")
    )
    text = F.coalesce(mine[text_col].cast("string"), F.lit(""))
    on = (
        mine[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")) & mine[host_col].cast("string").eqNullSafe(F.col("__host"))
    )
    met = mine.df.join(small(told, 500_000), on, "left").filter(F.coalesce("__kept", F.lit(True)))
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("__cut"), F.xxhash64(normal_line(x)))), "\n")
    return mine.back(met.withColumn(mine.key(text_col), F.when(F.size("__cut") > 0, rest).otherwise(mine[text_col])))
