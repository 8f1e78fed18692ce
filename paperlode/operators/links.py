"""Dataset links of a paper: extraction with context, candidates, scoring and the primary pick."""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlode import rules
from paperlode.config import LinkConfig
from paperlode.functions import scoring, text, urls
from paperlode.functions.basic import bind, blank_to_null, strip
from paperlode.operators.ranks import first_rows, row_numbers, top_rows
from paperlode.operators.windows import pivot_window

# --- extraction --------------------------------------------------------------------------------

OCCURRENCE = (
    "form: INT, pos: LONG, url: STRING, anchor: STRING, line: INT, section: STRING, "
    "ctx_before: ARRAY<STRING>, ctx_after: ARRAY<STRING>"
)


def extract_links(files: DataFrame, window: int = 2, content: str = "text") -> DataFrame:
    """One row per link of each source file, with line, section and neighbour sentences.

    Forms come in this order: href (0), url command (1), bare link (2). Sentences are split in the
    JVM; only the matching of positions, which Spark's own functions do not return, runs in Arrow batches, once per file.
    """
    keep = [c for c in files.columns if c != content]
    prepared = files.select(*[f"`{c}`" for c in keep], F.col(content).alias("__text"), text.split_sentences(F.col(content)).alias("__sentences"))
    schema = T.StructType([files.schema[c] for c in keep] + T._parse_datatype_string(OCCURRENCE).fields)
    rows = prepared.mapInArrow(_occurrences(len(keep), window), schema)
    return rows.withColumn("url", F.btrim(strip(urls.percent_decode(F.col("url"))), F.lit(").]")))


def link_windows(found: DataFrame, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """Each link with the window of sentences around its own place, the link itself in it as a pivot sentence."""
    pivot = F.concat(F.lit("[URL_PIVOT] "), F.coalesce(blank_to_null(F.col("anchor")), F.col("url")))
    tokens = F.transform(F.concat("ctx_before", F.array(pivot), "ctx_after"), text.count_tokens)
    window = pivot_window(F.col("ctx_before"), F.col("ctx_after"), pivot, tokens, cfg.window_tokens, cfg.min_sentences, cfg.pivot_context)
    return found.withColumn("window_sentences", window)


_FOUND = pa.schema([
    ("form", pa.int32()), ("pos", pa.int64()), ("url", pa.string()), ("anchor", pa.string()), ("line", pa.int32()), ("section", pa.string()),
    ("ctx_before", pa.list_(pa.string())), ("ctx_after", pa.list_(pa.string())),
])


def _occurrences(kept: int, window: int):
    """The links of each file behind its first ``kept`` columns; a file is matched once."""
    forms = [rules.HREF_PATTERN, rules.URL_COMMAND_PATTERN, rules.BARE_CONTEXT_LINK_PATTERN]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [re.compile(f) for f in forms]
        heading = re.compile(rules.SECTION_PATTERN)
        for batch in batches:
            texts, sentences = batch.column(kept), batch.column(kept + 1)
            owner, out = [], []
            for k in range(batch.num_rows):
                content = texts[k].as_py()
                found = [] if content is None else link_rows(content, sentences[k].as_py(), patterns, heading, window)
                owner += [k] * len(found)
                out += found
            files = [batch.column(j).take(pa.array(owner, pa.int32())) for j in range(kept)]
            made = pa.RecordBatch.from_pylist(out, schema=_FOUND)
            names = [*batch.schema.names[:kept], *_FOUND.names]
            yield pa.RecordBatch.from_arrays([*files, *made.columns], names=names)

    return find


def link_rows(content: str, sentences: list[str], patterns: list, heading, window: int) -> list[dict]:
    """Links of one file; positions are looked up by bisection."""
    from bisect import bisect_right
    from itertools import accumulate

    starts, ends, at = [], [], 0
    for s in sentences:
        at = max(content.find(s, at), at)
        starts.append(at)
        at += len(s)
        ends.append(at)
    lines = [0, *accumulate(len(line) + 1 for line in content.split("\n"))]
    heads = [(m.start(), m.group(1).strip()) for m in heading.finditer(content)]
    head_at = [p for p, _ in heads]
    out = []
    for form, pattern in enumerate(patterns):
        for m in pattern.finditer(content):
            pos = m.start()
            i = max(bisect_right(starts, pos) - 1, 0)
            if sentences and pos >= ends[i] and i < len(sentences) - 1:
                i = 0  # between two sentences
            h = bisect_right(head_at, pos)
            out.append({
                "form": form,
                "pos": pos,
                "url": m.group(1).strip(),
                "anchor": m.group(2).strip() if form == 0 else "",
                "line": bisect_right(lines, pos),
                "section": heads[h - 1][1] if h else "",
                "ctx_before": sentences[max(0, i - window):i],
                "ctx_after": sentences[i + 1:i + 1 + window],
            })
    return out


# --- candidates --------------------------------------------------------------------------------


def with_url_keys(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``norm_url`` and ``host_path``; later rules read these two columns only."""
    return df.withColumn("norm_url", urls.norm_url(F.col(url))).withColumn("host_path", urls.host_path(F.col("norm_url")))


def clean_context(sentences: Column, cfg: LinkConfig = LinkConfig()) -> Column:
    """Natural-language context from the first window sentences."""
    parts = F.transform(F.slice(sentences, 1, cfg.context_sentences), text.latex_to_text)
    return F.left(F.array_join(F.filter(parts, lambda p: p != ""), " "), F.lit(cfg.context_chars))


def build_candidates(links: DataFrame, order: list[str], cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """Distinct candidates of each paper with context and score.

    ``links`` has paper_id, url, anchor, window_sentences and the order columns. The first link per
    normalised URL wins; only the sentences of the context travel, and only winners get theirs cleaned.
    """
    keyed = with_url_keys(links.withColumn("url", strip(F.col("url"))).filter(F.col("url") != ""))
    narrow = keyed.withColumn("window_sentences", F.slice("window_sentences", 1, cfg.context_sentences))
    first = first_rows(narrow, ["paper_id", "norm_url"], [F.col(c) for c in order])
    return score_candidates(
        first.withColumn("anchor", strip(F.coalesce("anchor", F.lit(""))))
        .withColumn("ctx", clean_context(F.col("window_sentences"), cfg))
        .drop("window_sentences")
    )


def score_candidates(cands: DataFrame, whole_words: bool = False, reasons: bool = True) -> DataFrame:
    """Add ``score`` (and ``reasons``) to candidates that have norm_url, host_path, anchor and ctx."""
    said = F.lower(F.concat_ws(" ", F.coalesce("anchor", F.lit("")), F.coalesce("ctx", F.lit(""))))
    base = cands.withColumn("__said", said)
    parts = scoring.link_score_parts(F.col("norm_url"), F.col("host_path"), F.col("__said"), whole_words)
    found = {"score": scoring.total_points(parts)}
    if reasons:
        found["reasons"] = scoring.named_points(parts)
    return base.withColumns(found).drop("__said")


def keep_labelled(cands: DataFrame, labelled: DataFrame) -> DataFrame:
    """Candidates whose url an external classifier called a dataset."""
    return cands.join(labelled.filter("label = 'dataset'").select("url"), "url", "left_semi")


def keep_listed(picks: DataFrame, cands: DataFrame, normalised: bool = True) -> DataFrame:
    """External picks whose url is one of the candidates of the paper."""
    key = urls.norm_url if normalised else (lambda c: c)
    known = cands.select("paper_id", key(F.col("url")).alias("__u"))
    return picks.withColumn("__u", key(strip(F.col("url")))).filter("url <> ''").join(
        known, ["paper_id", "__u"], "left_semi"
    ).drop("__u")


# --- the pick ----------------------------------------------------------------------------------

_PICK = ["url", "anchor", "score", "host_path", "norm_url", "pos"]


def leading_candidates(cands: DataFrame, pos: str = "pos", k: int = 5) -> DataFrame:
    """The best ``k`` candidates of each paper in one bounded array ``top``, best first."""
    best = top_rows(cands, ["paper_id"], [F.col("score").desc(), F.col(pos)], k)
    entry = F.struct("rank", *[F.col(c) if c != "pos" else F.col(pos).alias("pos") for c in _PICK])
    return best.groupBy("paper_id").agg(F.array_sort(F.collect_list(entry)).alias("top"))


def _best(top: Column, test, *keys) -> Column:
    """The element that passes ``test`` with the largest keys, the earliest on ties."""
    passing = F.filter(top, test) if test else top
    keyed = F.transform(
        passing,
        lambda c: F.struct(*[k(c).alias(f"k{i}") for i, k in enumerate(keys)], (-c["rank"]).alias("back"), c.alias("c")),
    )
    return F.array_max(keyed)["c"]


def preferred_pick(top: Column) -> Column:
    """Best leading candidate on a preferred host: by score, then landing pages before files."""
    return _best(
        top,
        lambda c: urls.on_preferred_host(c["host_path"]),
        lambda c: c["score"],
        lambda c: urls.is_landing_page(c["norm_url"]),
    )


def has_clear_lead(top: Column) -> Column:
    """Score high enough, or high and well ahead of the runner-up."""
    s1, s2 = F.get(top, 0)["score"], F.get(top, 1)["score"]
    lead = (s1 >= rules.LEAD_SCORE) & (s1 - s2 >= rules.LEAD_GAP)
    return (s1 >= rules.DIRECT_SCORE) | F.coalesce(lead, F.lit(False))


def rule_pick(top: Column) -> Column:
    """A single candidate, a clear leader, or the best host class with a sufficient score; else null."""
    by_class = _best(
        top,
        None,
        lambda c: urls.host_class(c["host_path"]),
        lambda c: urls.is_landing_page(F.lower(c["url"])),
        lambda c: c["score"],
        lambda c: -F.length(c["url"]),
    )
    direct = (F.size(top) == 1) | has_clear_lead(top)
    return F.when(direct, F.get(top, 0)).when(by_class["score"] >= rules.MIN_PICK_SCORE, by_class)


def resolve_primary(
    cands: DataFrame, external: DataFrame | None = None, cfg: LinkConfig = LinkConfig(), pos: str = "pos"
) -> DataFrame:
    """One primary link per paper with the rule that chose it.

    ``external`` holds validated picks of a model (paper_id, url, why, confidence).
    """
    leading = leading_candidates(cands, pos, cfg.preferred_top)
    picked = leading.select(
        "paper_id",
        preferred_pick(F.col("top")).alias("preferred"),
        rule_pick(F.col("top")).alias("rule"),
        F.get("top", 0).alias("top1"),
    )
    picked = picked.withColumn("rule", F.coalesce("preferred", "rule"))
    if external is not None and cfg.mode != "rule":
        score_of = cands.select("paper_id", "url", F.col("score").alias("__score"), F.col("anchor").alias("__anchor"))
        ext = first_rows(
            external.join(score_of, ["paper_id", "url"]), ["paper_id"], [F.col("confidence").desc(), F.col("url")]
        ).select(
            "paper_id",
            F.struct(
                "url",
                F.coalesce(blank_to_null(F.col("why")), F.col("__anchor")).alias("why"),
                F.col("__score").alias("score"),
                F.col("confidence").cast("double").alias("confidence"),
            ).alias("external"),
        )
        picked = picked.join(ext, "paper_id", "left")
    else:
        picked = picked.withColumn(
            "external", F.lit(None).cast("struct<url: string, why: string, score: int, confidence: double>")
        )

    def option(tag: str, c: str, why: str) -> Column:
        conf = F.col("external.confidence") if c == "external" else F.lit(0.0)
        return F.when(
            F.col(c).isNotNull(),
            F.struct(
                F.lit(tag).alias("picked_by"),
                F.col(f"{c}.url").alias("url"),
                F.col(f"{c}.{why}").alias("why"),
                F.col(f"{c}.score").cast("int").alias("score"),
                conf.alias("confidence"),
            ),
        )

    by_rule, by_model = option("rule", "rule", "anchor"), option("llm", "external", "why")
    order = {"rule": [by_rule], "llm": [by_model], "hybrid": [by_rule, by_model]}[cfg.mode]
    if cfg.fallback_top1:
        order.append(option("fallback-top1", "top1", "anchor"))
    found = picked.select("paper_id", F.coalesce(*order).alias("p"))
    return (found if cfg.fallback_top1 else found.filter("p is not null")).select("paper_id", "p.*")


def ranked_candidates(cands: DataFrame, pos: str = "pos") -> DataFrame:
    """Audit rows: every candidate of a paper with its rank, best first.

    Ranks are spread by score, so a paper with very many candidates stays cheap.
    """
    numbered = row_numbers(cands, ["paper_id"], {"score": -F.col("score")}, [F.col(pos)], "rank")
    return numbered.withColumn("rank", (F.col("rank") + 1).cast("int"))


# --- what is written ---------------------------------------------------------------------------


def final_records(
    papers: DataFrame, picks: DataFrame, timestamp: Column, strict: bool = False
) -> DataFrame:
    """Ledger records of the picks.

    Only structural dataset links are written. ``strict`` trusts the pick's own description alone and
    drops picks without one; the default falls back to the paper description, then to "host — anchor".
    ``papers`` has paper_id, paper_link_pdf, dataset_description; ``picks`` has paper_id, url, desc, why.
    """
    # A filter moves below the columns it reads, so the test carries its own keys.
    rows = picks.withColumn("url", strip(F.col("url"))).filter(urls.with_keys(F.col("url"), urls.is_dataset_url))
    rows = rows.withColumn("norm_url", urls.norm_url(F.col("url"))).join(papers, "paper_id")
    said = F.coalesce(F.when(F.col("desc") != "", F.col("desc")), F.col("why"), F.lit(""))
    if strict:
        line = text.clean_summary(strip(said))
        described = rows.withColumn("__line", line).filter(F.col("__line") != "")
    else:

        def summary(c: Column) -> Column:
            """Clean line of a text; null if nothing or only the link itself is left."""
            line = text.clean_summary_with_hosts(text.links_to_hosts(strip(c)))
            return bind(line, lambda s: F.when((s != "") & (urls.norm_url(s) != F.col("norm_url")), s))

        anchor = F.coalesce(blank_to_null(F.col("why")), F.lit("dataset link"))
        described = rows.withColumn(
            "__line",
            F.coalesce(
                summary(said),
                summary(F.coalesce("dataset_description", F.lit(""))),
                F.concat(urls.url_host(F.col("url")), F.lit(" — "), anchor),
            ),
        )
    return described.select(
        F.col("paper_link_pdf").alias("Paper Link"),
        F.col("url").alias("Dataset Link"),
        F.col("__line").alias("Dataset Description"),
        timestamp.alias("Timestamp"),
    )


def fan_out_links(records: DataFrame, links: str = "links", keep_empty: bool = True) -> DataFrame:
    """One row per distinct link, sorted; papers without one keep a blank row or none."""
    distinct = F.array_sort(F.array_distinct(F.filter(links, lambda u: u.isNotNull() & (u != ""))))
    rows = records.withColumn(links, distinct)
    others = [c for c in records.columns if c != links]
    if keep_empty:
        return rows.select(*others, F.explode_outer(links).alias("link")).fillna("", ["link"])
    return rows.select(*others, F.explode(links).alias("link"))


def link_block(cands: DataFrame, pos: str = "pos", k: int = 8) -> DataFrame:
    """Summary block of the best links of each paper: "host — anchor" lines without repeats."""
    best = top_rows(cands, ["paper_id"], [F.col("score").desc(), F.col(pos)], k)
    anchor = F.coalesce(F.when(F.col("anchor") != "", F.col("anchor")), F.lit("dataset link"))
    said = text.clean_summary(anchor)
    line = F.concat(urls.url_host(F.col("url")), F.lit(" — "), F.when(said != "", said).otherwise("dataset link"))
    lines = F.array_distinct(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: F.concat(F.lit("- "), x["line"]))
    )
    return best.withColumn("line", line).groupBy("paper_id").agg(
        F.concat(F.lit("[DATASET LINKS]\n"), F.array_join(lines, "\n")).alias("block")
    )


def append_block(description: Column, block: Column) -> Column:
    """Description with the block behind it, once."""
    base = strip(F.coalesce(description, F.lit("")))
    grown = F.when(base == "", block).otherwise(F.concat(base, F.lit("\n\n"), block))
    return F.when(block.isNull() | base.contains(block), base).otherwise(grown)
