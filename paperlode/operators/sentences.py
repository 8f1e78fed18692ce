"""Sentence corpora: ids, neighbour context, labels and descriptions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.functions.basic import not_blank, rstrip, strip
from paperlode.functions.text import sections_of, split_sentences, title_of
from paperlode.operators.ranks import last_seen, position_block, running_total


def corpus_items(texts: DataFrame, text: str = "text", name: str | None = None) -> DataFrame:
    """Tagged full texts as corpus items: one row per section with its sentences.

    ``name`` is the fallback paper name where a text carries no title.
    """
    title = title_of(F.col(text))
    paper = F.when(title != "", title).otherwise(F.col(name)) if name else title
    items = texts.select(paper.alias("paper_name"), F.explode(sections_of(F.col(text))).alias("s"))
    flat = items.select("paper_name", "s.section", "s.paragraph_id", "s.full_text")
    sentence = F.transform(
        split_sentences(F.col("full_text")),
        lambda t, i: F.struct(i.cast("int").alias("sentence_id"), t.alias("text"), F.lit(0).alias("label")),
    )
    return flat.withColumn("sentences", sentence)


def explode_sentences(items: DataFrame, sentences: str = "sentences") -> DataFrame:
    """One row per sentence; ``pos`` is its place in the paragraph."""
    keep = [c for c in items.columns if c != sentences]
    rows = items.select(*keep, F.posexplode(sentences).alias("pos", "__s"))
    return rows.select(*keep, "pos", "__s.*")


def non_blank_sentences(items: DataFrame, sentences: str = "sentences") -> DataFrame:
    """Non-blank sentences with the pair (item position, sentence position) that leads back to them."""
    return explode_sentences(items, sentences).filter(not_blank(F.col("text"))).withColumn("text", strip(F.col("text")))


def item_offsets(items: DataFrame, size: Column, name: str = "offset") -> DataFrame:
    """Number of sentences of the paper before each item, in (section, paragraph_id) order.

    Works on paragraphs, not sentences, and spreads long papers over tasks.
    """
    return running_total(
        items,
        ["paper_name"],
        {"section": F.col("section"), "block": position_block(F.col("paragraph_id"), 1024)},
        [F.col("paragraph_id"), *_stable(items)],
        size,
        name,
    )


def _stable(items: DataFrame) -> list[Column]:
    return [F.col("item_pos")] if "item_pos" in items.columns else []


def global_sentence_ids(items: DataFrame, sentences: str = "sentences", name: str = "gid") -> DataFrame:
    """One row per sentence with its running index in the paper, from 0."""
    offsets = item_offsets(items, F.size(sentences), "__offset")
    return (
        explode_sentences(offsets, sentences)
        .withColumn(name, (F.col("__offset") + F.col("pos")).cast("long"))
        .drop("__offset")
    )


def consecutive_groups(items: DataFrame) -> DataFrame:
    """Number runs of equal paper names in file order (``file``, ``item_pos``) as ``group_no`` from 0."""
    # A run starts where the name before differs; the item before is found by an equi-join on position.
    before = items.select("file", (F.col("item_pos") + 1).alias("item_pos"), F.col("paper_name").alias("__before"))
    marked = items.join(before, ["file", "item_pos"], "left").withColumn(
        "__starts", (~F.col("paper_name").eqNullSafe(F.col("__before")) | (F.col("item_pos") == 0)).cast("int")
    )
    counted = running_total(
        marked,
        ["file"],
        {"block": position_block(F.col("item_pos"))},
        [F.col("item_pos")],
        F.col("__starts"),
        "__runs_before",
    )
    return counted.withColumn("group_no", F.col("__runs_before") + F.col("__starts") - 1).drop(
        "__before", "__starts", "__runs_before"
    )


def neighbour_context(rows: DataFrame, keys: list[str], order: str, text: str = "text", width: int = 2) -> DataFrame:
    """Sentences before and after each sentence, at most ``width`` on each side.

    ``order`` is a gap-free index. Neighbours meet by joining on blocks of the index: each row is
    sent to its own block, and rows near an edge also to the next one, so a hot key spreads out.
    """
    size = 4096
    block = position_block(F.col(order), size)
    edges = F.array_distinct(
        F.array(
            block,
            position_block(F.col(order) - width, size),
            position_block(F.col(order) + width, size),
        )
    )
    spread = rows.withColumn("__home", block).withColumn("__block", F.explode(edges))
    window = Window.partitionBy(*keys, "__block").orderBy(order)
    return (
        spread.withColumn("ctx_before", F.collect_list(text).over(window.rowsBetween(-width, -1)))
        .withColumn("ctx_after", F.collect_list(text).over(window.rowsBetween(1, width)))
        .filter(F.col("__block") == F.col("__home"))
        .drop("__block", "__home")
    )


def array_context(sentences: Column, index: Column, width: int = 2) -> tuple[Column, Column]:
    """Neighbours of one sentence (index from 0) inside a sentence array."""
    start = F.greatest(index - width, F.lit(0))
    return (
        F.slice(sentences, start + 1, index - start),
        F.slice(sentences, index + 2, F.lit(width)),
    )


def apply_predictions(sentences: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Write predicted labels back; sentences without one keep their label, else 0."""
    found = predictions.select(*keys, F.col("label").alias("__new"))
    return (
        sentences.join(found, keys, "left")
        .withColumn("label", F.coalesce("__new", "label", F.lit(0)).cast("int"))
        .drop("__new")
    )


def apply_label_map(sentences: DataFrame, labels: DataFrame) -> DataFrame:
    """Write labels given per running index of the non-blank sentences back to their place."""
    return apply_predictions(sentences, labels, ["paper_name", "gid"])


def apply_positional_labels(sentences: DataFrame, answers: DataFrame) -> DataFrame:
    """Older form: an answer is an array of labels per paper; sentence i takes element i, the rest stays."""
    rows = answers.select("paper_name", F.posexplode("labels").alias("gid", "label"))
    return apply_predictions(sentences, rows.withColumn("gid", F.col("gid").cast("long")), ["paper_name", "gid"])


def cut_description(text: Column, max_chars: int | None) -> Column:
    if not max_chars:
        return text
    cut = F.concat(rstrip(F.left(text, F.lit(max_chars))), F.lit(" ..."))
    return F.when(F.length(text) > max_chars, cut).otherwise(text)


def join_positive(sentences: Column, max_chars: int | None = None) -> Column:
    """Description from an in-row array of (text, label)."""
    chosen = F.filter(sentences, lambda s: (s["label"] == 1) & not_blank(s["text"]))
    return cut_description(F.array_join(F.transform(chosen, lambda s: strip(s["text"])), " "), max_chars)


def collect_description(
    sentences: DataFrame,
    keys: list[str],
    order: list[str],
    max_chars: int | None = None,
    first_section_only: bool = False,
) -> DataFrame:
    """Positive sentences of each paper in order, joined to one description.

    Only positive sentences enter the shuffled lists. Papers without one give an empty description.
    A cap is applied before the lists are built if one numeric column gives the order. The older form
    looks at the first section only.
    """
    rows = sentences
    if first_section_only:
        head = rows.groupBy(*keys).agg(F.min(F.struct("section", "paragraph_id")).alias("__first"))
        rows = rows.join(head, keys).filter(F.struct("section", "paragraph_id") == F.col("__first"))
    positive = (F.col("label") == 1) & not_blank(F.col("text"))
    if max_chars and len(order) == 1:
        # Sentences that begin behind the cut cannot show, so a long paper sends only its first ones.
        rows = rows.withColumn("__size", F.when(positive, F.length(strip(F.col("text"))) + 1).otherwise(0))
        place = F.col(order[0])
        rows = running_total(rows, keys, {"block": position_block(place, 4096)}, [place], F.col("__size"), "__start")
        positive = positive & (F.col("__start") <= max_chars + 1)
    chosen = F.when(positive, F.struct(*order, strip(F.col("text")).alias("text")))
    found = F.transform(F.array_sort(F.collect_list(chosen)), lambda s: s["text"])
    return rows.groupBy(*keys).agg(cut_description(F.array_join(found, " "), max_chars).alias("description"))


def description_gate(records: DataFrame, threshold: float = 0.5, min_chars: int = 1) -> DataFrame:
    """Gate structs of a stage record; the caller filters on ``desc_gate.accepted``."""
    length = F.length(F.coalesce("dataset_description", F.lit("")))
    return records.withColumns(
        {
            "bert_gate": F.struct(
                F.col("gate_prob").alias("prob"),
                F.lit(threshold).alias("threshold"),
                (F.col("gate_prob") >= threshold).alias("accepted"),
            ),
            "desc_gate": F.struct(
                (length >= min_chars).alias("accepted"),
                length.alias("desc_len"),
                F.lit(min_chars).alias("min_desc_chars"),
            ),
        }
    )


def chunk_sentences(rows: DataFrame, keys: list[str], index: str, size: int) -> DataFrame:
    """Fixed-size chunks over a gap-free index: no shuffle at all."""
    return rows.withColumn("chunk", F.floor(F.col(index) / size).cast("long"))


def section_asof(links: DataFrame, headings: DataFrame, keys: list[str]) -> DataFrame:
    """Heading at or before each link position (``pos``); empty before the first heading."""
    extra = [c for c in links.columns if c not in keys + ["pos"]]
    rows = links.select(
        *keys, "pos", F.lit(1).alias("__kind"), F.struct(*extra).alias("__link"), F.lit(None).cast("string").alias("section")
    )
    marks = headings.select(
        *keys, "pos", F.lit(0).alias("__kind"), F.lit(None).cast(rows.schema["__link"].dataType).alias("__link"), "section"
    )
    found = last_seen(
        rows.unionByName(marks), keys, {"block": position_block(F.col("pos"))}, ["pos", "__kind"], "section", "__found"
    )
    return found.filter("__kind = 1").select(
        *keys, "pos", "__link.*", F.coalesce("__found", F.lit("")).alias("section")
    )


def sentence_at(positions: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Index of the sentence whose span holds each position.

    After the last span it is the last sentence; in a gap between spans it is sentence 0.
    """
    extra = [c for c in positions.columns if c not in keys + ["pos"]]
    span = F.struct("sid", "span_end")
    rows = positions.select(
        *keys, "pos", F.lit(1).alias("__kind"), F.struct(*extra, F.lit(0).alias("__x")).alias("__row"),
        F.lit(None).cast("struct<sid: long, span_end: long>").alias("__span"),
    )
    ends = spans.groupBy(*keys).agg(F.max("sid").cast("long").alias("__last"))
    starts = spans.select(
        *keys, F.col("span_start").cast("long").alias("pos"), F.lit(0).alias("__kind"),
        F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"),
        F.struct(F.col("sid").cast("long").alias("sid"), F.col("span_end").cast("long").alias("span_end")).alias("__span"),
    )
    found = last_seen(
        rows.withColumn("pos", F.col("pos").cast("long")).unionByName(starts),
        keys, {"block": position_block(F.col("pos"))}, ["pos", "__kind"], "__span", "__found",
    ).filter("__kind = 1")
    inside = F.col("pos") < F.col("__found.span_end")
    sid = F.when(inside | (F.col("__found.sid") == F.col("__last")), F.col("__found.sid")).otherwise(F.lit(0))
    return (
        found.join(ends, keys, "left")
        .select(*keys, "pos", "__row.*", F.coalesce(sid, F.lit(0)).cast("long").alias("sentence_index"))
        .drop("__x")
    )


def line_number(text: Column, pos: Column) -> Column:
    """Line (from 1) of a character position (from 0)."""
    head = F.left(text, pos)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")
