"""Queries of the column functions (F) and the predicates (P)."""

from pyspark.sql import functions as F

from paperlode import rules
from paperlode.functions import dates, responses, scoring, text, urls, vectors
from paperlode.functions.basic import strip
from paperlode.operators import filters, quality, retrieval
from paperlode.operators.links import (
    append_block,
    extract_links,
    fan_out_links,
    final_records,
    link_block,
    score_candidates,
    with_url_keys,
)
from paperlode.operators.ledger import normalise_fields, prune_blank, require_links
from paperlode.operators.ranks import top_rows
from paperlode.operators.sentences import description_gate, non_blank_sentences
from paperlode.operators.statistics import update_span
from paperlode.queries.base import (
    S_DOCUMENT_SENTENCES,
    S_PAGE_LINKS,
    S_PREDICTIONS,
    document_sentences,
    page_links,
    pages_with_links,
    predictions,
    query,
    s_any,
    s_array,
    s_sentences,
    s_squeeze,
    s_strip,
    s_strip_tags,
    table,
)

# --- SQL of the URL rules ----------------------------------------------------------------------


def s_norm(u: str) -> str:
    """Normalised URL for inputs with plain queries."""
    body = f"split_part({s_strip(u)}, '#', 1)"
    head = f"regexp_replace(split_part({body}, '?', 1), '^[A-Za-z][A-Za-z0-9+.-]*:', '')"
    pieces = f"list_filter(string_split(split_part({body}, '?', 2), '&'), lambda q: q <> '' AND NOT starts_with(lower(q), 'utm_'))"
    full = f"list_transform({pieces}, lambda q: CASE WHEN contains(q, '=') THEN q ELSE q || '=' END)"
    return (
        f"(rtrim(lower({head}), '/') || CASE WHEN len({pieces}) > 0 THEN '?' || array_to_string({full}, '&') ELSE '' END)"
    )


def s_host_path(n: str) -> str:
    return f"regexp_replace(split_part({n}, '?', 1), '^//', '')"


S_KEYED = S_PAGE_LINKS + f""",
keyed AS (SELECT paper_id, pos, html, url, anchor, {s_norm('url')} AS norm_url FROM page_links),
hosted AS (SELECT *, {s_host_path('norm_url')} AS host_path FROM keyed)"""

GITHUB_RELEASE = "(contains(host_path, 'github.com') AND contains(host_path, '/releases'))"
GITHUB_DATA = (
    "(contains(host_path, 'github.com') AND (contains(host_path, '/blob/main/data') OR contains(host_path, '/tree/main/data')))"
)


def s_ends(e: str, endings: list[str]) -> str:
    return "(" + " OR ".join(f"ends_with({e}, '{x}')" for x in endings) + ")"


S_IS_DATASET = (
    f"(NOT {s_any('host_path', rules.REJECTED_HOSTS)} AND ({s_any('host_path', rules.DATA_HOSTS)} "
    f"OR {s_ends('norm_url', rules.DATA_ENDINGS)} OR {GITHUB_RELEASE} OR {GITHUB_DATA} "
    "OR (contains(host_path, 'github.com') AND contains(host_path, '/data/')) "
    "OR (contains(host_path, 'kaggle.com') AND contains(host_path, '/datasets/'))))"
)


def s_score_parts(said: str) -> list[tuple[str, str, str]]:
    """(reason, test, points) of the additive score."""
    parts = [(f"host+:{h}", f"contains(host_path, '{h}')", str(w)) for h, w in rules.HOST_WEIGHTS[:-1]]
    parts += [
        ("host+:github.com/", "starts_with(host_path, 'github.com/')", "0"),
        ("host+:gh_releases", GITHUB_RELEASE, "6"),
        ("host+:gh_data_dir", GITHUB_DATA, "5"),
        ("host+:raw.githubusercontent.com", "contains(host_path, 'raw.githubusercontent.com')", "3"),
    ]
    parts += [(f"host-:{h}", f"contains(host_path, '{h}')", str(w)) for h, w in rules.HOST_PENALTIES]
    parts.append((
        "gh_repo_root",
        f"(contains(host_path, 'github.com') AND NOT ({GITHUB_RELEASE} OR {GITHUB_DATA} OR contains(host_path, '/data/')))",
        "-4",
    ))
    parts += [(f"path:{p}", f"contains(host_path, '{p}')", str(w)) for p, w in rules.PATH_WEIGHTS]
    before = "FALSE"
    for ending, weight in rules.FILE_ENDING_WEIGHTS:
        parts.append((f"ext:{ending}", f"(ends_with(norm_url, '{ending}') AND NOT ({before}))", str(weight)))
        before += f" OR ends_with(norm_url, '{ending}')"

    def hits(words: list[str]) -> str:
        return "(" + " + ".join(f"CAST(contains({said}, '{w}') AS INTEGER)" for w in words) + ")"

    good, bad = hits(rules.POSITIVE_WORDS), hits(rules.NEGATIVE_WORDS)
    parts.append(("kw_pos", f"{good} > 0", f"least(8, {good} * 2)"))
    parts.append(("kw_neg", f"{bad} > 0", f"(-least(6, {bad} * 2))"))
    for a, b in rules.NEGATIVE_PHRASES:
        parts.append(("kw_neg_phrase", f"(contains({said}, '{a}') AND contains({said}, '{b}'))", "-3"))
    return parts


def s_score(said: str) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN {t} THEN {p} ELSE 0 END" for _, t, p in s_score_parts(said)) + " AS INTEGER)"


def s_reasons(said: str) -> str:
    items = ", ".join(f"CASE WHEN {t} THEN '{n}:' || CAST({p} AS VARCHAR) END" for n, t, p in s_score_parts(said))
    return f"array_to_string(list_filter([{items}], lambda r: r IS NOT NULL), ',')"


def s_latex(e: str) -> str:
    """LaTeX clean-up; the back reference of the block rule is spelled out per block."""
    for block in rules.TEX_BLOCKS:
        for name in (block, block + "\\*"):
            e = f"regexp_replace({e}, '(?is)\\\\begin\\{{{name}\\}}.*?\\\\end\\{{{name}\\}}', ' ', 'g')"
    e = f"regexp_replace({e}, '\\$[^$]*\\$|\\\\\\([^)]*\\\\\\)|\\\\\\[[^\\]]*\\\\\\]', ' ', 'g')"
    for names in (rules.TEX_REFERENCES, rules.TEX_DROPPED, rules.TEX_INCLUDES):
        e = f"regexp_replace({e}, '\\\\({'|'.join(names)})\\s*\\{{[^}}]*\\}}', ' ', 'g')"
    e = f"regexp_replace({e}, '\\\\({'|'.join(rules.TEX_FORMATS)})\\s*\\{{([^}}]*)\\}}', '\\2', 'g')"
    e = f"regexp_replace({e}, '(?i)(https?://|doi:)\\S+', ' ', 'g')"
    e = f"regexp_replace({e}, '[{{}}]', '', 'g')"
    for old, new in rules.TEX_CHARACTERS:
        e = "replace({}, '{}', '{}')".format(e, old.replace("'", "''"), new)
    return s_squeeze(e)


def s_latex_kept(clean: str) -> str:
    letters = f"length(regexp_replace({clean}, '[^\\pL\\pN]', '', 'g'))"
    return (
        f"CASE WHEN length({clean}) < 12 OR (length({clean}) - {letters}) / length({clean}) > 0.38 THEN '' ELSE {clean} END"
    )


def s_symbols(e: str) -> str:
    return f"length(regexp_replace({e}, '[^{{}}\\[\\]()<>=_`#*~^$\\\\|;]', '', 'g'))"


S_LEAK = r"(?im)(\bEVIDENCE\b|\bOUTPUT\s*FORMAT\b|\{context\}|\bTool Response\b|\bAgent\b|\bAPI[-\s]|```|^>>|^#+\s)"


def s_looks_like_code(e: str) -> str:
    return (
        f"({e} <> '' AND (regexp_matches({e}, '{S_LEAK}') OR regexp_matches({e}, '^\\s*[{{\\[][^\\n]*[\\]}}]') "
        f"OR regexp_matches({e}, '^[A-Z ][A-Z0-9 \\-:_]{{12,}}\\z') "
        f"OR (length({e}) >= 48 AND {s_symbols(e)} / length({e}) > 0.14)))"
    )


def s_one_line(e: str) -> str:
    tagless = f"regexp_replace({s_squeeze(e)}, '{rules.ROLE_TAG_PATTERN}', '', 'g')"
    return f"regexp_replace({tagless}, '(?s)```.*?```', '', 'g')"


# Summary lines: document text with links, role tags, code or leaked prompts mixed in.
_MIX = ["", "Assistant: ", "```code```", "EVIDENCE ", "{{{{{{{{{{{{{{{{{{{{{{{{{{ ", "See https://Data.Example.org/a?b=1 ", "[1] ", "x "]


def _summaries(spark, sf):
    d = table(spark, sf, "documents")
    mixed = F.array(*[F.lit(m) for m in _MIX])[(F.col("doc_id") % len(_MIX)).cast("int")]
    return d.select("doc_id", F.concat(mixed, F.col("text")).alias("text"))


S_SUMMARIES = f"summaries AS (SELECT doc_id, {s_array(_MIX)}[doc_id % {len(_MIX)} + 1] || text AS text FROM documents)"

# LaTeX: commands put in the place of common letter groups of the whole text.
_TEX = [(". ", ". \\cite{a, b} "), (", ", ", \\emph{so} "), (".\n", ". $x^2$\n\\begin{figure}y\\end{figure} "), ("tion", "\\textbf{tion}")]


def _latex(c):
    for old, new in _TEX:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def s_tex(e: str) -> str:
    for old, new in _TEX:
        old = old.replace("\n", "' || chr(10) || '")
        new = new.replace("\n", "' || chr(10) || '")
        e = f"replace({e}, '{old}', '{new}')"
    return e


# --- F: URLs -----------------------------------------------------------------------------------


@query("f01_norm_url", f"""WITH {S_KEYED}
SELECT paper_id, pos, norm_url FROM hosted UNION ALL
SELECT page_id, -1, {s_norm('url')} FROM pages""")
def f01(spark, sf):
    links = with_url_keys(page_links(spark, sf)).select("paper_id", "pos", "norm_url")
    own = table(spark, sf, "pages").select(
        F.col("page_id").alias("paper_id"), F.lit(-1).alias("pos"), urls.norm_url(F.col("url")).alias("norm_url")
    )
    return links.unionByName(own)


@query("f02_host_path", f"WITH {S_KEYED} SELECT host_path, count(*) AS n FROM hosted GROUP BY 1")
def f02(spark, sf):
    return with_url_keys(page_links(spark, sf)).groupBy("host_path").agg(F.count(F.lit(1)).alias("n"))


_ID_FORMS = [
    "https://arxiv.org/abs/2401.{n}v1", "http://arxiv.org/pdf/2401.{n}v2.pdf", "https://arxiv.org/html/2401.{n}",
    "https://arxiv.org/html/cs-{n}?x=1", "https://example.org/{n}#part",
]


@query("f03_paper_ids", f"""WITH forms AS (
  SELECT doc_id, replace({s_array(_ID_FORMS)}[doc_id % 5 + 1], '{{n}}', lpad(CAST(doc_id AS VARCHAR), 5, '0')) AS link FROM documents),
based AS (SELECT *, split_part(split_part(link, '#', 1), '?', 1) AS base FROM forms),
found AS (SELECT *, regexp_extract(base, 'arxiv\\.org/(abs|pdf|html)/([0-9]{{4}}\\.[0-9]{{4,5}}(v\\d+)?)', 2) AS known FROM based)
SELECT doc_id,
  CASE WHEN known <> '' THEN 'https://arxiv.org/pdf/' || known || '.pdf'
       WHEN contains(base, 'arxiv.org/html/') THEN 'https://arxiv.org/pdf/' || split_part(base, '/html/', 2) || '.pdf'
       ELSE base END AS pdf_link,
  nullif(regexp_extract(link, 'arxiv\\.org/pdf/([0-9]{{4}}\\.[0-9]{{4,5}}(v\\d+)?)\\.pdf', 1), '') AS pdf_id,
  nullif(regexp_extract(link, '/pdf/(\\d{{4}}\\.\\d+v\\d+)\\.pdf\\z', 1), '') AS ledger_id,
  nullif(regexp_extract(link, '(\\d{{4}}\\.\\d{{5}}(?:v\\d+)?)', 1), '') AS text_id
FROM found""")
def f03(spark, sf):
    form = F.array(*[F.lit(v) for v in _ID_FORMS])[(F.col("doc_id") % 5).cast("int")]
    link = F.replace(form, F.lit("{n}"), F.lpad(F.col("doc_id").cast("string"), 5, "0"))
    rows = table(spark, sf, "documents").select("doc_id", link.alias("link"))
    c = F.col("link")
    return rows.select(
        "doc_id", urls.canonical_pdf_link(c).alias("pdf_link"), urls.id_from_pdf_link(c).alias("pdf_id"),
        urls.id_from_ledger_link(c).alias("ledger_id"), urls.id_from_text(c).alias("text_id"),
    )


@query("f04_clean_link", f"""WITH {S_PAGE_LINKS}
SELECT paper_id, pos, url_decode(replace(trim({s_strip("'  (' || url || '%2Fz%20y].);' || ' '")}, ').,;]'), '+', '%2B')) AS link FROM page_links""")
def f04(spark, sf):
    raw = F.concat(F.lit("  ("), F.col("url"), F.lit("%2Fz%20y].);"), F.lit(" "))
    return page_links(spark, sf).select("paper_id", "pos", urls.clean_link(raw).alias("link"))


# The document text with a heading in front, then a link of each form and a tail behind it. The pattern of bare links also
# meets the addresses inside the commands.
_F05_LINKS = [
    ("At \\href{{{}}}{{our data}}.", "https://zenodo.org/record/"), ("See \\url{{{}}}.", "https://kaggle.com/datasets/"),
    ("Also {} here.", "https://figshare.com/articles/"),
]
_F05_TAIL = ["Tail one.", "Tail two.", "Tail three."]
_F05_SAID = [f"'{said.format(chr(39) + ' || ' + repr(link) + ' || doc_id || ' + chr(39))}'" for said, link in _F05_LINKS]
#: (form, place of the link among the sentences behind the text)
_F05_FOUND = [(0, 0), (1, 1), (2, 0), (2, 1), (2, 2)]


def _s_f05_rows() -> str:
    row = "{{'form': {}, 'place': {}, 'url': '{}' || doc_id, 'anchor': '{}'}}"
    return ", ".join(row.format(form, k, _F05_LINKS[k][1], "our data" if form == 0 else "") for form, k in _F05_FOUND)


@query("f05_links_with_context", f"""WITH parts AS (
  SELECT doc_id, source, {s_strip("replace(text, chr(13), '')")} AS body FROM documents),
split AS (
  SELECT doc_id, source, '\\section{{' || source || '}}. ' || body || '. ' AS prefix,
         {s_sentences("'\\section{' || source || '}. ' || body || '.'")} AS s,
         [{', '.join(_F05_SAID)}, {', '.join(f"'{t}'" for t in _F05_TAIL)}] AS tail, [{_s_f05_rows()}] AS found FROM parts),
rows AS (SELECT * EXCLUDE (found), unnest(found) AS f FROM split),
around AS (SELECT *, len(s) + f.place + 1 AS k, list_concat(s, tail) AS every FROM rows)
SELECT doc_id, CAST(f.form AS INTEGER) AS form, f.url AS url, f.anchor AS anchor, source AS section,
  CAST(length(prefix) - length(replace(prefix, chr(10), '')) + 1 AS INTEGER) AS line,
  array_to_string(every[greatest(1, k - 2):k - 1], '|') AS ctx_before, array_to_string(every[k + 1:k + 2], '|') AS ctx_after
FROM around""")
def f05(spark, sf):
    body = strip(F.replace(F.col("text"), F.lit("\r"), F.lit("")))
    said = [F.format_string(form.format(link + "%d"), "doc_id") for form, link in _F05_LINKS]
    content = F.concat(F.lit("\\section{"), F.col("source"), F.lit("}. "), body, F.lit(". "), F.concat_ws(" ", *said, *map(F.lit, _F05_TAIL)))
    files = table(spark, sf, "documents").select("doc_id", content.alias("text"))
    return extract_links(files).select(
        "doc_id", "form", "url", "anchor", "section", "line",
        F.array_join("ctx_before", "|").alias("ctx_before"), F.array_join("ctx_after", "|").alias("ctx_after"),
    )


# --- F: text -----------------------------------------------------------------------------------


@query("f06_split_sentences", f"WITH {S_DOCUMENT_SENTENCES} SELECT paper_name AS doc_id, gid AS pos, text AS sentence FROM doc_sents")
def f06(spark, sf):
    return document_sentences(spark, sf).select(F.col("paper_name").alias("doc_id"), F.col("gid").alias("pos"), F.col("text").alias("sentence"))


@query("f07_split_capital", f"""WITH marked AS (
  SELECT doc_id, regexp_replace({s_squeeze('text')}, '([.!?])\\s+([A-Z("\\[])', '\\1' || chr(1) || '\\2', 'g') AS m FROM documents)
SELECT doc_id, CAST(len(s) AS INTEGER) AS n, array_to_string(s, '|') AS sentences FROM (
  SELECT doc_id, list_filter(list_transform(string_split(m, chr(1)), lambda p: {s_strip('p')}), lambda p: p <> '') AS s FROM marked)""")
def f07(spark, sf):
    s = text.split_sentences_capital(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", s.alias("s")).select(
        "doc_id", F.size("s").alias("n"), F.array_join("s", "|").alias("sentences")
    )


def s_hidden(e: str) -> str:
    """Text with the dots of abbreviations hidden."""
    for short in rules.ABBREVIATIONS:
        e = "replace({}, '{}', '{}')".format(e, short, short.replace(".", "' || chr(57344) || '"))
    return e


@query("f08_split_abbrev", f"""WITH marked AS (
  SELECT doc_id, regexp_replace(regexp_replace({s_hidden("replace(text, ', ', ', e.g. ')")}, '\\.([A-Z])', '. \\1', 'g'),
    '([.!?])(\\s|[A-Z]|\\z)', '\\1' || chr(1) || '\\2', 'g') AS m FROM documents),
found AS (SELECT doc_id, list_concat(regexp_extract_all(m, '[^.!?' || chr(1) || ']+[.!?]' || chr(1)),
    list_filter([regexp_extract(m, '([^.!?' || chr(1) || ']+)\\z', 1)], lambda x: {s_strip('x')} <> '')) AS s FROM marked),
clean AS (SELECT doc_id, list_transform(s, lambda x: {s_strip("replace(replace(x, chr(1), ''), chr(57344), '.')")}) AS s FROM found),
ended AS (SELECT doc_id, list_filter(list_transform(s, lambda x: CASE WHEN regexp_matches(x, '[.!?]\\z') THEN x ELSE x || '.' END), lambda x: x <> '.') AS s FROM clean)
SELECT doc_id, CAST(len(s) AS INTEGER) AS n, array_to_string(s, '|') AS sentences FROM ended""")
def f08(spark, sf):
    c = F.replace(F.col("text"), F.lit(", "), F.lit(", e.g. "))
    return table(spark, sf, "documents").select("doc_id", text.split_sentences_abbrev(c).alias("s")).select(
        "doc_id", F.size("s").alias("n"), F.array_join("s", "|").alias("sentences")
    )


@query("f09_latex_to_text", f"""WITH tex AS (SELECT doc_id, {s_tex('text')} AS t FROM documents),
clean AS (SELECT doc_id, {s_latex('t')} AS c FROM tex)
SELECT doc_id, {s_latex_kept('c')} AS plain FROM clean""")
def f09(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.latex_to_text(_latex(F.col("text"))).alias("plain"))


S_SAID = "lower(anchor)"


@query("f10_link_score", f"""WITH {S_KEYED}
SELECT paper_id, pos, {s_score(S_SAID)} AS score, {s_reasons(S_SAID)} AS reasons FROM hosted""")
def f10(spark, sf):
    cands = with_url_keys(page_links(spark, sf)).withColumn("ctx", F.lit(""))
    return score_candidates(cands).select("paper_id", "pos", "score", F.array_join("reasons", ",").alias("reasons"))


_BASIC = [
    ("host_hint", s_any("host_path", rules.DATA_HOSTS), 5), ("path_hint", s_any("host_path", rules.DATA_PATHS), 3),
    ("file_ext", s_ends("norm_url", rules.DATA_ENDINGS), 3), ("neg_host", s_any("host_path", rules.REJECTED_HOSTS), -3),
    ("github_repo_root", "(contains(host_path, 'github.com') AND NOT (contains(host_path, '/releases') OR contains(host_path, '/data')))", -3),
    ("ctx_pos", s_any(S_SAID, rules.CONTEXT_WORDS), 3), ("ctx_neg", s_any(S_SAID, rules.CONTEXT_ANTI_WORDS), -2),
]


@query("f11_basic_link_score", f"""WITH {S_KEYED}
SELECT paper_id, pos, CAST({' + '.join(f'CASE WHEN {t} THEN {p} ELSE 0 END' for _, t, p in _BASIC)} AS INTEGER) AS score,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {t} THEN '{n}' END" for n, t, _ in _BASIC)}], lambda r: r IS NOT NULL), ',') AS reasons
FROM hosted""")
def f11(spark, sf):
    rows = with_url_keys(page_links(spark, sf)).withColumn("said", F.lower("anchor"))
    args = (F.col("norm_url"), F.col("host_path"), F.col("said"))
    return rows.select(
        "paper_id", "pos", scoring.basic_link_score(*args).alias("score"),
        F.array_join(scoring.basic_link_reasons(*args), ",").alias("reasons"),
    )


@query("f12_clean_summary", f"""WITH {S_SUMMARIES}, lines AS (SELECT doc_id, {s_one_line('text')} AS l FROM summaries)
SELECT doc_id, CASE WHEN {s_looks_like_code(s_strip('l'))} THEN ''
  ELSE {s_strip("regexp_replace(l, 'https?://[^\\s)\\]]+', '', 'g')")} END AS line FROM lines""")
def f12(spark, sf):
    return _summaries(spark, sf).select("doc_id", text.clean_summary(F.col("text")).alias("line"))


@query("f13_summary_with_hosts", f"""WITH {S_SUMMARIES}, lines AS (SELECT doc_id, {s_one_line('text')} AS l FROM summaries),
hosted AS (SELECT doc_id, l, regexp_replace(l, 'https?://Data.Example.org/a\\?b=1', 'data.example.org', 'g') AS h FROM lines)
SELECT doc_id, CASE WHEN {s_looks_like_code(s_strip('l'))} OR length(h) < 18 THEN '' ELSE h END AS line FROM hosted""")
def f13(spark, sf):
    return _summaries(spark, sf).select("doc_id", text.clean_summary_with_hosts(F.col("text")).alias("line"))


@query("f14_truncate_request", f"""WITH {S_PAGE_LINKS}, req AS (
  SELECT paper_id, pos, '[URL] ' || url || chr(10) || '[ANCHOR] ' || anchor || chr(10) || '[CONTEXT] ' AS h,
         {s_strip("html")} AS b FROM page_links)
SELECT paper_id, pos, CASE WHEN length(h || b) <= 400 THEN h || b
  ELSE h || {"rtrim(left(b, greatest(0, 400 - 3 - CAST(length(h) AS INTEGER))), ' ' || chr(9) || chr(10) || chr(13))"} || '...' END AS request FROM req""")
def f14(spark, sf):
    made = text.request_text(F.col("url"), F.col("anchor"), F.col("html"))
    return page_links(spark, sf, html=F.col("html")).select("paper_id", "pos", text.truncate_request(made, 400).alias("request"))


def _label_request_sql() -> str:
    head = text.LABEL_REQUEST.replace("\n", "' || chr(10) || '")
    for name, value in (("{title}", "paper_name"), ("{first}", "'1'"), ("{last}", "CAST(len(s) AS VARCHAR)")):
        head = head.replace(name, f"' || {value} || '")
    lines = "array_to_string(list_transform(s, lambda t, i: '句子' || i || ': ' || t), chr(10))"
    return f"'{head}' || {lines}"


@query("f15_label_request", f"""WITH p AS (
  SELECT doc_id, source AS paper_name, {s_sentences('text')} AS s FROM documents)
SELECT doc_id, md5({_label_request_sql()}) AS digest, length({_label_request_sql()}) AS n FROM p""")
def f15(spark, sf):
    made = text.label_request(F.col("source"), text.split_sentences(F.col("text")), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", made.alias("r")).select(
        "doc_id", F.md5("r").alias("digest"), F.length("r").cast("long").alias("n")
    )


@query("f15_pick_request", f"""WITH {S_KEYED}, s AS (SELECT *, {s_score('lower(anchor)')} AS score FROM hosted),
top AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, pos) AS rank FROM s QUALIFY rank <= 12), entries AS (
  SELECT paper_id, rank, rank || ') ' || url || chr(10) || 'linked as ' || anchor || ' on ' || split_part(host_path, '/', 1)
    || '; points by rule ' || score || chr(10) || 'nearby text ' || anchor || chr(10) AS line FROM top)
SELECT paper_id, md5('{text.PICK_REQUEST.replace(chr(10), "' || chr(10) || '")}' || 'The paper is called: p' || paper_id || chr(10) || 'It says of itself: a'
  || chr(10) || chr(10) || 'Links, best first:' || chr(10) || string_agg(line, chr(10) ORDER BY rank)) AS digest FROM entries GROUP BY paper_id""")
def f15_pick(spark, sf):
    """The best twelve candidates of each paper in one request."""
    cands = score_candidates(with_url_keys(page_links(spark, sf)).withColumn("ctx", F.lit("")), reasons=False)
    best = top_rows(cands, ["paper_id"], [F.col("score").desc(), F.col("pos")], 12)
    entry = F.struct(
        "rank", "url", urls.url_host(F.col("norm_url")).alias("host"), "anchor", "score", F.col("anchor").alias("ctx")
    )
    per_paper = best.groupBy("paper_id").agg(F.array_sort(F.collect_list(entry)).alias("c"))
    made = text.pick_request(F.concat(F.lit("p"), F.col("paper_id").cast("string")), F.lit("a"), F.col("c"))
    return per_paper.select("paper_id", F.md5(made).alias("digest"))


@query("f16_context_fallback", f"""WITH c AS (
  SELECT doc_id, left({s_squeeze("'锚文本: ' || source || ' | 章节: ' || lang || ' | 前文: ' || text")}, 800) AS ctx FROM documents),
p AS (SELECT doc_id, ctx, {s_strip("array_to_string(list_slice(string_split(regexp_replace(ctx, '([。.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1, 2), ' ')")} AS base FROM c)
SELECT doc_id, ctx AS context, CASE WHEN length(base) > 120 THEN left(base, 120) || '…' ELSE base END AS short FROM p""")
def f16(spark, sf):
    none = F.array().cast("array<string>")
    ctx = text.link_context(F.lit(None).cast("string"), F.col("source"), F.col("lang"), F.array("text"), none)
    return table(spark, sf, "documents").select("doc_id", ctx.alias("context")).withColumn(
        "short", text.short_description(F.col("context"))
    )


_LABELS = ["Dataset", "data source", "CODE", "github repo", "paper", ""]


def s_low_label(e: str) -> str:
    folded = f"CASE WHEN contains({e}, 'data') THEN 'dataset' ELSE {e} END"
    return f"CASE WHEN {s_any('(' + folded + ')', ['code', 'repo', 'github'])} THEN 'code' ELSE ({folded}) END"


S_HEURISTIC = (
    f"CASE WHEN {s_any('ctx', rules.DATASET_CLUES)} THEN 'dataset' WHEN {s_any('ctx', rules.CODE_CLUES)} THEN 'code' ELSE 'other' END"
)


@query("f17_normalize_label", f"""WITH {S_PAGE_LINKS}, raw AS (
  SELECT paper_id, pos, lower(anchor) AS ctx, coalesce(nullif(lower({s_array(_LABELS)}[pos % 6 + 1]), ''), 'other') AS l FROM page_links),
folded AS (SELECT *, {s_low_label('l')} AS f FROM raw)
SELECT paper_id, pos, CASE WHEN f IN ('dataset', 'code', 'other') THEN f ELSE {S_HEURISTIC} END AS label,
  CASE WHEN f IN ('dataset', 'code', 'other') THEN '{rules.WHY_CONTEXT}' WHEN {S_HEURISTIC} = 'other' THEN '{rules.WHY_NONE}' ELSE '{rules.WHY_KEYWORD}' END AS why
FROM folded""")
def f17(spark, sf):
    label = F.array(*[F.lit(v) for v in _LABELS])[F.col("pos") % 6]
    ctx = F.col("anchor")
    return page_links(spark, sf).select(
        "paper_id", "pos", responses.normalized_label(label, ctx).alias("label"),
        responses.normalized_reason(label, F.lit(None).cast("string"), ctx).alias("why"),
    )


# Answers of a model: items built from the conversation turns, in five loose JSON shapes.
def _answers(spark, sf):
    c = table(spark, sf, "conversations")
    item = F.to_json(F.struct(F.concat(F.lit("u"), F.col("conv_id")).alias("url"), F.col("role").alias("label"), F.col("text").alias("why")))
    second = F.to_json(F.struct(F.lit("z").alias("url"), F.lit("other").alias("label")))
    shape = F.col("turn") % 5
    content = (
        F.when(shape == 0, F.concat(F.lit("["), item, F.lit(", "), second, F.lit("]")))
        .when(shape == 1, F.concat(F.lit("```json\n{\"items\": ["), item, F.lit(", "), second, F.lit("]}\n```")))
        .when(shape == 2, F.concat(F.lit("Here it is: ["), item, F.lit(", "), second, F.lit("] as asked.")))
        .when(shape == 3, F.concat(item, F.lit("\n"), second))
        .otherwise(F.concat(item, second))
    )
    return c.select("conv_id", "turn", content.alias("content"))


@query("f18_parse_items", """SELECT conv_id, turn, CAST(2 AS INTEGER) AS n, 'u' || conv_id AS url, role AS label, text AS why, 'z' AS second_url FROM conversations""")
def f18(spark, sf):
    parsed = _answers(spark, sf).withColumn("i", responses.parse_items(F.col("content")))
    first, second = F.get("i", 0), F.get("i", 1)
    return parsed.select(
        "conv_id", "turn", F.size("i").alias("n"), first["url"].alias("url"), first["label"].alias("label"),
        first["why"].alias("why"), second["url"].alias("second_url"),
    )


# Label answers: one line per sentence of a document, the first sentence labelled twice.
def _label_answers(spark, sf):
    s = text.split_sentences(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", s.alias("s"))
    lines = F.transform("s", lambda t, i: F.concat(F.lit("句子"), (i + 1).cast("string"), F.lit(",标记为"), (F.length(t) % 2).cast("string"), F.lit("。解释：x")))
    return d.select("doc_id", F.size("s").alias("n"), F.concat(F.lit("Answer:\n"), F.array_join(lines, "\n"), F.lit("\n句子1，标记为1\n句子999999,标记为1。")).alias("content"))


S_LABEL_ANSWERS = f"""
ans AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS gid FROM (SELECT doc_id, {s_sentences('text')} AS s FROM documents))"""


@query("f19_parse_label_lines", f"""WITH {S_LABEL_ANSWERS}
SELECT doc_id, CAST(gid AS INTEGER) AS gid, CAST(CASE WHEN gid = 0 THEN 1 ELSE length(t) % 2 END AS INTEGER) AS label FROM ans""")
def f19(spark, sf):
    found = responses.parse_label_lines(F.col("content"), F.lit(0), F.col("n"))
    return _label_answers(spark, sf).select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")


@query("f19_labels_positional", f"""WITH {S_LABEL_ANSWERS}
SELECT doc_id, count(*) + 1 AS n, string_agg(CAST(length(t) % 2 AS VARCHAR), '' ORDER BY gid) || '1' AS labels FROM ans GROUP BY doc_id""")
def f19_positional(spark, sf):
    found = responses.parse_labels_positional(F.col("content"))
    return _label_answers(spark, sf).select(
        "doc_id", F.size(found).cast("long").alias("n"), F.array_join(found.cast("array<string>"), "").alias("labels")
    )


@query("f20_parse_label_array", f"""WITH d AS (SELECT doc_id, {s_sentences('text')} AS s FROM documents)
SELECT doc_id, array_to_string(list_transform(s, lambda t: CASE WHEN length(t) % 3 = 1 THEN '1' ELSE '0' END), '') AS labels, TRUE AS complete FROM d""")
def f20(spark, sf):
    s = text.split_sentences(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", s.alias("s"))
    content = F.concat(F.lit('{"labels": ['), F.array_join(F.transform("s", lambda t: (F.length(t) % 3).cast("string")), ","), F.lit("]}"))
    labels = responses.parse_label_array(content)
    return d.select(
        "doc_id", F.array_join(labels.cast("array<string>"), "").alias("labels"), (F.size(labels) == F.size("s")).alias("complete")
    )


@query("f21_parse_urls", "SELECT page_id, url || '|https://zenodo.org/' || page_id AS urls FROM pages")
def f21(spark, sf):
    p = table(spark, sf, "pages")
    code = F.concat(F.lit("https://zenodo.org/"), F.col("page_id").cast("string"))
    answer = F.concat(
        F.lit('Sure: {"urls": {"dataset": ["'), F.col("url"), F.lit('"], "code": ["'), code, F.lit('", "'), F.col("url"), F.lit('"]}} done')
    )
    found = responses.parse_url_object(answer)
    return p.select("page_id", F.array_join(F.filter(found, lambda u: u == F.col("url")), "").alias("a"), F.array_join(F.filter(found, lambda u: u != F.col("url")), "").alias("b")).select(
        "page_id", F.concat_ws("|", "a", "b").alias("urls")
    )


@query("f22_search_text", """SELECT doc_id, md5('lang: ' || lang || ' n_chars: ' || n_chars || CASE WHEN source <> '' THEN ' source: ' || source ELSE '' END
  || CASE WHEN text <> '' THEN ' text: ' || text ELSE '' END) AS digest FROM documents""")
def f22(spark, sf):
    rows = retrieval.search_text(table(spark, sf, "documents"), ["text", "source", "n_chars", "lang"])
    return rows.select("doc_id", F.md5("search_text").alias("digest"))


@query("f23_with_instruction", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Find the paper' || chr(10) || chr(10) || text ELSE text END AS query FROM benchmark")
def f23(spark, sf):
    instruction = F.when(F.col("item_id") % 2 == 0, "Find the paper").otherwise("")
    return table(spark, sf, "benchmark").select("item_id", retrieval.with_instruction(F.col("text"), instruction).alias("query"))


@query("f24_reflow_lines")
def f24(spark, sf):
    """Order-dependent line merging; checked on literal fixtures."""
    return table(spark, sf, "documents").select("doc_id", text.reflow_lines(F.col("text")).alias("lines")).select(
        "doc_id", F.size("lines").alias("n"), F.array_join("lines", "\n").alias("text")
    )


@query("f25_titled_lines", f"""WITH t AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: {s_strip('l')}), lambda l: l <> '') AS ls, source, text AS x FROM documents)
SELECT doc_id, source AS title, length({s_strip('x')}) AS rest, array_to_string(list_transform(ls, lambda l: '[TITLE]' || source || '[/TITLE]' || l), chr(10)) AS lines FROM t""")
def f25(spark, sf):
    tagged = F.concat(F.lit("[TITLE]"), F.col("source"), F.lit("[/TITLE]\n"), F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", text.title_of(tagged).alias("title"), F.length(text.without_titles(tagged)).cast("long").alias("rest"), F.array_join(text.titled_lines(tagged), "\n").alias("lines")
    )


@query("f26_sections", f"""WITH p AS (SELECT doc_id, string_split(text, '.' || chr(10)) AS parts, source FROM documents),
r AS (SELECT doc_id, unnest(parts) AS body, generate_subscripts(parts, 1) - 1 AS paragraph_id, source FROM p)
SELECT doc_id, CAST(paragraph_id AS INTEGER) AS paragraph_id, source || '-' || paragraph_id AS section, {s_strip('body')} AS full_text FROM r""")
def f26(spark, sf):
    parts = F.transform(
        F.split("text", r"\.\n"),
        lambda b, i: F.concat(F.lit("[SECTION] "), F.col("source"), F.lit("-"), i.cast("string"), F.lit(" [/SECTION]\n"), b, F.lit("\n")),
    )
    d = table(spark, sf, "documents").select("doc_id", F.explode(text.sections_of(F.array_join(parts, ""))).alias("s"))
    return d.select("doc_id", "s.paragraph_id", "s.section", "s.full_text")


@query("f27_strip_tags", f"SELECT page_id, {s_strip_tags('html')} AS plain FROM pages")
def f27(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


# --- F: dates ----------------------------------------------------------------------------------


@query("f28_year", """SELECT doc_id, CASE WHEN regexp_matches(substr(trim(t), 1, 4), '^[+-]?[0-9]+\\s*$') AND length(trim(t)) >= 4 THEN TRY_CAST(substr(trim(t), 1, 4) AS INTEGER) END AS year FROM (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(1990 + doc_id % 40 AS VARCHAR) || '-01-01' WHEN 1 THEN 'abc' WHEN 2 THEN ' 2025-11-11T00:00:00Z' ELSE text END AS t FROM documents)""")
def f28(spark, sf):
    i = F.col("doc_id") % 4
    t = (
        F.when(i == 0, F.concat((1990 + F.col("doc_id") % 40).cast("string"), F.lit("-01-01"))).when(i == 1, "abc")
        .when(i == 2, " 2025-11-11T00:00:00Z").otherwise(F.col("text"))
    )
    return table(spark, sf, "documents").select("doc_id", dates.year_of(t).alias("year"))


@query("f29_times", """SELECT event_id, strftime(ts, '%Y%m%d%H%M') AS feed_time, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso,
  strftime(ts, '%a, %-d %b %Y') AS heading, strftime(ts, '%y') AS yy FROM events""")
def f29(spark, sf):
    raw = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ts = dates.utc(raw)
    return table(spark, sf, "events").select(
        "event_id", dates.feed_time(ts).alias("feed_time"), dates.iso_seconds(ts).alias("iso"),
        dates.day_heading(ts).alias("heading"), dates.two_digit_year(F.year(ts)).alias("yy"),
    )


@query("f30_submitted_on", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE strftime(o_orderdate, '%-d %b %Y') END AS written,
  CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def f30(spark, sf):
    line = F.when(F.col("o_orderkey") % 3 == 0, "no date").otherwise(
        F.concat(F.lit("[Submitted on "), F.date_format("o_orderdate", "d MMM yyyy"), F.lit(" (v1)]"))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.submitted_on(line).alias("written"), dates.submitted_date(line).cast("string").alias("day")
    )


@query("f31_update_span", """SELECT user_id, count(*) AS entries, strftime(max(ts) FILTER (event_id % 10 <> 0), '%Y-%m-%dT%H:%M:%SZ') AS newest,
  strftime(min(ts) FILTER (event_id % 10 <> 0), '%Y-%m-%dT%H:%M:%SZ') AS oldest FROM events GROUP BY user_id""")
def f31(spark, sf):
    updated = F.when(F.col("event_id") % 10 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return update_span(table(spark, sf, "events").select("user_id", updated.alias("updated")), ["user_id"])


# --- F: vectors and metrics --------------------------------------------------------------------


@query("f32_cosine", """WITH m AS (SELECT label, list(x ORDER BY i) AS c FROM (
    SELECT label, i, avg(v) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 6) AS cosine, 1.0::DOUBLE AS unit FROM embeddings JOIN m USING (label)""")
def f32(spark, sf):
    e = table(spark, sf, "embeddings")
    place = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("x"))
    # One value per dimension: the group is bounded by the vector length.
    center = place.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    unit = vectors.norm(vectors.l2_normalize(F.transform("embedding", lambda x: x * 3)))
    return e.join(center, "label").select(
        "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("c")), 6).alias("cosine"), F.round(unit, 6).alias("unit")
    )


@query("f34_candidate_key", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'p' || doc_id WHEN 1 THEN 'd' || doc_id ELSE source END AS link FROM documents""")
def f34(spark, sf):
    i = F.col("doc_id") % 3
    d = F.col("doc_id").cast("string")
    paper = F.when(i == 0, F.concat(F.lit(" p"), d, F.lit(" "))).otherwise("  ")
    dataset = F.when(i < 2, F.concat(F.lit("d"), d))
    return table(spark, sf, "documents").select("doc_id", urls.candidate_key(paper, dataset, F.col("source")).alias("link"))


@query("f35_softmax", """WITH l AS (SELECT event_id, value / 10 AS a, (user_id % 7) / 2.0 AS b FROM events)
SELECT event_id, round(exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS p0,
  CAST(CASE WHEN b > a THEN 1 ELSE 0 END AS INTEGER) AS label,
  round(1 / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS confidence FROM l""")
def f35(spark, sf):
    logits = F.array(F.col("value") / 10, F.col("user_id") % 7 / 2.0)
    rows = table(spark, sf, "events").select("event_id", logits.alias("l")).withColumn("p", vectors.softmax(F.col("l")))
    return rows.select(
        "event_id", F.round(F.get("p", 0), 6).alias("p0"), vectors.arg_max(F.col("l")).alias("label"),
        F.round(vectors.confidence(F.col("p")), 6).alias("confidence"),
    )


@query("f36_sha1", "SELECT doc_id, sha1(text) AS digest FROM documents")
def f36(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha1("text").alias("digest"))


@query("f37_error_types", f"""WITH {S_PREDICTIONS}
SELECT paper_name, sentence_index + 1 AS sentence_no, predicted_label = true_label AS is_correct,
  CASE WHEN predicted_label = true_label THEN NULL WHEN predicted_label = 1 THEN 'False Positive' ELSE 'False Negative' END AS error_type FROM preds""")
def f37(spark, sf):
    return quality.tag_errors(predictions(spark, sf)).select("paper_name", "sentence_no", "is_correct", "error_type")


@query("f38_relabel_differences", f"""WITH {S_PREDICTIONS}, n AS (SELECT paper_name, sentence_index, true_label AS old_label, length(text) % 4 AS new_label FROM preds)
SELECT paper_name, sentence_index, CAST(old_label AS INTEGER) AS old_label, CAST(new_label AS INTEGER) AS new_label FROM n WHERE new_label IN (0, 1) AND new_label <> old_label""")
def f38(spark, sf):
    p = predictions(spark, sf)
    old = p.select("paper_name", "sentence_index", F.col("true_label").alias("label"))
    new = p.select("paper_name", "sentence_index", (F.length("text") % 4).alias("new_label"))
    return quality.relabel_differences(old, new, ["paper_name", "sentence_index"]).select("paper_name", "sentence_index", "old_label", "new_label")


@query("f38_relabel_totals", f"""WITH {S_PREDICTIONS}
SELECT count(*) AS total, count(*) FILTER (length(text) % 4 IN (0, 1) AND length(text) % 4 <> true_label) AS changed FROM preds""")
def f38_totals(spark, sf):
    p = predictions(spark, sf)
    old = p.select("paper_name", "sentence_index", F.col("true_label").alias("label"))
    new = p.select("paper_name", "sentence_index", (F.length("text") % 4).alias("new_label"))
    return quality.relabel_totals(old, new, ["paper_name", "sentence_index"])


@query("f39_flatten_predictions", f"""WITH {S_DOCUMENT_SENTENCES}
SELECT CAST(paper_name AS VARCHAR) AS paper_name, CAST(CASE WHEN gid % 5 = 0 THEN -1 ELSE gid END AS INTEGER) AS sentence_index,
  CAST(CASE WHEN gid % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS predicted_label, round(length(text) % 10 / 10.0, 6) AS prob_1,
  round(CASE WHEN gid % 2 = 0 THEN length(text) % 10 / 10.0 ELSE 0.9 END, 6) AS confidence, text AS sentence_text FROM doc_sents""")
def f39(spark, sf):
    sentence = F.transform(
        text.split_sentences(F.col("text")),
        lambda t, i: F.struct(
            F.when(i % 5 != 0, i).alias("sentence_index"),
            F.when(i % 3 != 0, 1).alias("predicted_label"),
            F.lit(None).cast("int").alias("true_label"),
            F.struct(F.lit(None).cast("double").alias("class_0"), (F.length(t) % 10 / 10.0).alias("class_1")).alias("probabilities"),
            F.when(i % 2 != 0, 0.9).alias("confidence"),
            t.alias("sentence_text"),
        ),
    )
    nested = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("paper_name"), sentence.alias("sentences"))
    return quality.flatten_predictions(nested).select(
        "paper_name", "sentence_index", "predicted_label", F.round("prob_1", 6).alias("prob_1"), F.round("confidence", 6).alias("confidence"), "sentence_text"
    )


S_SCORED = S_KEYED + f""",
scored AS (SELECT paper_id, pos, url, anchor, norm_url, host_path, {s_score(S_SAID)} AS score FROM hosted)"""


@query("f40_link_block", f"""WITH {S_SCORED},
top AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, pos) AS rank FROM scored QUALIFY rank <= 8),
lines AS (SELECT paper_id, '- ' || split_part(host_path, '/', 1) || ' — ' || CASE WHEN {s_looks_like_code(s_squeeze('anchor'))} OR {s_squeeze('anchor')} = '' THEN 'dataset link' ELSE {s_squeeze('anchor')} END AS line, min(rank) AS rank
  FROM top GROUP BY 1, 2)
SELECT paper_id, 'Base text' || chr(10) || chr(10) || '[DATASET LINKS]' || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS description FROM lines GROUP BY paper_id""")
def f40(spark, sf):
    cands = score_candidates(with_url_keys(page_links(spark, sf)).withColumn("ctx", F.lit("")), reasons=False)
    return link_block(cands).select("paper_id", append_block(F.lit(" Base text "), F.col("block")).alias("description"))


@query("f41_final_records", f"""WITH {S_SCORED}, dataset AS (SELECT * FROM scored WHERE {S_IS_DATASET}),
said AS (SELECT *, CASE WHEN pos % 2 = 0 THEN {s_squeeze('anchor')} ELSE '' END AS why FROM dataset),
own AS (SELECT *, CASE WHEN {s_looks_like_code('why')} OR length(why) < 18 THEN '' ELSE why END AS own FROM said)
SELECT 'https://arxiv.org/pdf/' || paper_id || '.pdf' AS "Paper Link", url AS "Dataset Link",
  CASE WHEN own <> '' THEN own WHEN paper_id % 2 = 0 THEN 'A paper about page ' || paper_id || ' and data'
       ELSE split_part(host_path, '/', 1) || ' — ' || CASE WHEN why <> '' THEN why ELSE 'dataset link' END END AS "Dataset Description", 'now' AS "Timestamp" FROM own""")
def f41(spark, sf):
    links = page_links(spark, sf)
    picks = links.select(
        "paper_id", "url", F.lit("").alias("desc"), F.when(F.col("pos") % 2 == 0, F.col("anchor")).otherwise("").alias("why")
    )
    described = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("A paper about page "), F.col("page_id").cast("string"), F.lit(" and data")))
    known = table(spark, sf, "pages").select(
        F.col("page_id").alias("paper_id"),
        F.concat(F.lit("https://arxiv.org/pdf/"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("paper_link_pdf"),
        described.alias("dataset_description"),
    )
    return final_records(known, picks, F.lit("now"))


@query("f41_final_records_strict", f"""WITH {S_SCORED}, said AS (SELECT *, CASE WHEN pos % 2 = 0 THEN {s_squeeze('anchor')} ELSE '' END AS why FROM scored WHERE {S_IS_DATASET})
SELECT paper_id || '.pdf' AS "Paper Link", url AS "Dataset Link", why AS "Dataset Description", 'now' AS "Timestamp" FROM said WHERE why <> '' AND NOT {s_looks_like_code('why')}""")
def f41_strict(spark, sf):
    picks = page_links(spark, sf).select(
        "paper_id", "url", F.lit("").alias("desc"), F.when(F.col("pos") % 2 == 0, F.col("anchor")).otherwise("").alias("why")
    )
    known = table(spark, sf, "pages").select(
        F.col("page_id").alias("paper_id"), F.concat(F.col("page_id").cast("string"), F.lit(".pdf")).alias("paper_link_pdf"),
        F.lit("").alias("dataset_description"),
    )
    return final_records(known, picks, F.lit("now"), strict=True)


@query("f42_link_fan_out", f"""WITH {S_PAGE_LINKS}
SELECT DISTINCT paper_id, url AS link FROM page_links UNION ALL
SELECT page_id, '' FROM pages WHERE page_id NOT IN (SELECT paper_id FROM page_links)""")
def f42(spark, sf):
    return fan_out_links(pages_with_links(spark, sf).withColumn("links", F.transform("links", lambda x: x["url"])))


# --- P: predicates and projections -------------------------------------------------------------

@query("p01_gate", "SELECT event_id, round(least(value / 100, 1.0), 6) AS gate_prob FROM events WHERE least(value / 100, 1.0) >= 0.5")
def p01(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("gate_prob"))
    return filters.gate(rows).withColumn("gate_prob", F.round("gate_prob", 6))


@query("p02_gate_text", f"""SELECT doc_id, {s_strip("source || ' ' || text")} AS content FROM documents WHERE {s_strip("source || ' ' || text")} <> ''""")
def p02(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lit("u").alias("url"), F.col("source").alias("title"), F.col("text").alias("abstract"))
    return quality.gate_content(d)


@query("p03_valid_labels", f"""SELECT doc_id, {s_strip("source || ' ' || text")} AS content, CAST(doc_id % 2 AS INTEGER) AS label FROM documents WHERE doc_id % 5 <> 0""")
def p03(spark, sf):
    label = F.when(F.col("doc_id") % 5 == 0, "maybe").otherwise((F.col("doc_id") % 2).cast("string"))
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("abstract"), label.alias("label"))
    return quality.gate_content(d, "label")


@query("p04_target_day", "SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def p04(spark, sf):
    return filters.on_day(table(spark, sf, "events"), "2024-01-15", "ts").select("event_id")


@query("p05_look_back", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-17' AND TIMESTAMP '2024-01-20'")
def p05(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_type", "category")
    found = filters.look_back(e, "view", 3, F.lit("2024-01-20").cast(e.schema["ts"].dataType), "ts")
    return found.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("p06_date_range", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def p06(spark, sf):
    o = table(spark, sf, "orders")
    kind = o.schema["o_orderdate"].dataType
    return filters.in_range(o, F.lit("1996-01-01").cast(kind), F.lit("1996-12-31").cast(kind), "o_orderdate").select("o_orderkey", "o_orderstatus")


@query("p07_is_dataset_url", f"WITH {S_KEYED} SELECT paper_id, pos, {S_IS_DATASET} AS is_dataset FROM hosted")
def p07(spark, sf):
    rows = with_url_keys(page_links(spark, sf))
    return rows.select("paper_id", "pos", urls.is_dataset_url(F.col("norm_url"), F.col("host_path")).alias("is_dataset"))


@query("p08_description_gate", """WITH r AS (SELECT doc_id, n_chars % 100 / 100.0 AS p, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS t FROM documents)
SELECT doc_id, round(p, 6) AS prob, p >= 0.5 AS accepted, length(t) >= 1 AS described, CAST(length(t) AS INTEGER) AS desc_len FROM r""")
def p08(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") % 100 / 100.0).alias("gate_prob"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text")).alias("dataset_description")
    )
    return description_gate(d).select(
        "doc_id", F.round("bert_gate.prob", 6).alias("prob"), F.col("bert_gate.accepted").alias("accepted"),
        F.col("desc_gate.accepted").alias("described"), F.col("desc_gate.desc_len").alias("desc_len"),
    )


@query("p09_prune_blank", "SELECT doc_id FROM documents WHERE doc_id % 4 NOT IN (0, 1)")
def p09(spark, sf):
    i = F.col("doc_id") % 4
    described = F.when(i == 0, F.lit(None).cast("string")).when(i == 1, " \t\u00a0").otherwise(F.col("text"))
    return prune_blank(table(spark, sf, "documents").withColumn("Dataset Description", described)).select("doc_id")


@query("p09_require_links", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0")
def p09_links(spark, sf):
    paper = F.when(F.col("doc_id") % 3 == 0, "\u3000").otherwise(F.col("source"))
    link = F.when(F.col("doc_id") % 5 != 0, F.col("lang"))
    return require_links(table(spark, sf, "documents").withColumns({"Paper Link": paper, "Dataset Link": link})).select("doc_id")


@query("p10_allowed_hosts", f"WITH {S_PAGE_LINKS} SELECT paper_id, pos, url, anchor FROM page_links WHERE {s_any('lower(url)', rules.ALLOWED_HOSTS)}")
def p10(spark, sf):
    return page_links(spark, sf).filter(urls.host_allowed(F.col("url")))


S_LATEX_TEST = (
    "(regexp_matches(t, '\\$[^$]+\\$') OR regexp_matches(t, '\\\\\\([^)]*\\\\\\)|\\\\\\[[^\\]]*\\\\\\]') "
    f"OR regexp_matches(t, '(?i)\\\\({'|'.join(rules.TEX_GREEK + rules.TEX_MATH)})\\b') OR regexp_matches(t, '(?s)[\\^_][{{\\[]?.'))"
)


@query("p11_has_latex", f"""SELECT doc_id, {S_LATEX_TEST} AS has_latex FROM (
  SELECT doc_id, source || chr(10) || CASE WHEN doc_id % 3 = 0 THEN replace(text, 'tion', '\\Alpha tion') ELSE text END AS t FROM documents)""")
def p11(spark, sf):
    abstract = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("tion"), F.lit("\\Alpha tion"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.has_latex(F.concat_ws("\n", "source", abstract)).alias("has_latex"))


@query("p12_looks_like_code", f"WITH {S_SUMMARIES}, c AS (SELECT doc_id, {s_strip('text')} AS t FROM summaries) SELECT doc_id, {s_looks_like_code('t')} AS is_code FROM c")
def p12(spark, sf):
    return _summaries(spark, sf).select("doc_id", text.looks_like_code(F.col("text")).alias("is_code"))


@query("p13_normalise_fields", """SELECT 'https://arxiv.org/pdf/' || doc_id AS "Paper Link", '' AS "Dataset Link", coalesce(CASE WHEN doc_id % 2 = 0 THEN text END, '') AS "Dataset Description",
  CAST(n_chars AS VARCHAR) AS "Timestamp", lang FROM documents""")
def p13(spark, sf):
    d = table(spark, sf, "documents").select(
        F.concat(F.lit("https://arxiv.org/pdf/"), F.col("doc_id").cast("string")).alias("nameless"),
        F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("Dataset Description"), F.col("n_chars").alias("Timestamp"), "lang",
    )
    return normalise_fields(d, "nameless")


@query("p14_result_columns", "SELECT n_chars AS score, source AS paper_link, lang AS dataset_link, text AS description, CAST(doc_id AS VARCHAR) AS timestamp FROM documents")
def p14(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("n_chars").alias("score"), F.col("source").alias("Paper Link"), F.col("lang").alias("Dataset Link"),
        F.col("text").alias("Dataset Description"), F.col("doc_id").cast("string").alias("Timestamp"),
    )
    return retrieval.result_columns(d)


@query("p15_flatten_sentences", f"""WITH p AS (SELECT doc_id, string_split(text, ',') AS s FROM documents),
r AS (SELECT doc_id, unnest(s) AS text, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos FROM p)
SELECT doc_id, pos, {s_strip('text')} AS text FROM r WHERE {s_strip('text')} <> ''""")
def p15(spark, sf):
    pieces = F.transform(F.split("text", ","), lambda t, i: F.struct(i.alias("sentence_id"), t.alias("text")))
    return non_blank_sentences(table(spark, sf, "documents").select("doc_id", pieces.alias("sentences"))).select("doc_id", "pos", "text")


@query("p16_safe_names", """SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^\\pL\\pN._-]', '_', 'g'), '_'), ''), 'model') AS slug,
  trim(regexp_replace(url, '[^\\pL\\pN _-]', '_', 'g')) AS title, rtrim(regexp_replace(url, '[^\\pL\\pN _-]', '', 'g')) AS file_name FROM pages""")
def p16(spark, sf):
    c = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", urls.slug(c).alias("slug"), urls.safe_title(c).alias("title"), urls.safe_file_name(c).alias("file_name")
    )


@query("p17_preview", "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS preview, regexp_replace(left(text, 120), '\\s+', ' ', 'g') AS log_line FROM documents")
def p17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"), text.log_preview(F.col("text")).alias("log_line"))
