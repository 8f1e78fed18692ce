"""URL and identifier expressions; all stay in the JVM."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlode import rules
from paperlode.functions.basic import any_of, bind, blank_to_null, contains_any, ends_with_any, rstrip, strip

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _percent_safe(c: Column) -> Column:
    """Guard percent signs that start no escape, so decoding never fails."""
    return F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")


def percent_decode(c: Column) -> Column:
    """Decode %XX escapes and keep plus signs."""
    return F.url_decode(F.replace(_percent_safe(c), F.lit("+"), F.lit("%2B")))


def _form_decode(c: Column) -> Column:
    return F.url_decode(_percent_safe(c))


def _form_encode(c: Column) -> Column:
    encoded = F.url_encode(c)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _before_fragment(c: Column) -> Column:
    return F.substring_index(c, "#", 1)


def _after_scheme(c: Column) -> Column:
    """Authority and path of a URL, without scheme, query and fragment."""
    return F.regexp_replace(F.substring_index(_before_fragment(c), "?", 1), _SCHEME, "")


def authority(c: Column) -> Column:
    """Host part with port and user, as written."""
    return F.regexp_extract(_after_scheme(c), r"^//([^/]*)", 1)


def clean_query(raw: Column) -> Column:
    """Query without ``utm_*`` keys, decoded and re-encoded piece by piece."""

    def piece(p: Column) -> Column:
        name = F.substring_index(p, "=", 1)
        value = F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")
        return F.struct(_form_decode(name).alias("name"), _form_decode(value).alias("value"))

    pieces = F.transform(F.filter(F.split(raw, "&"), lambda p: p != ""), piece)
    kept = F.filter(pieces, lambda p: ~F.lower(p["name"]).startswith("utm_"))
    joined = F.transform(
        kept, lambda p: F.concat(_form_encode(p["name"]), F.lit("="), _form_encode(p["value"]))
    )
    return F.array_join(joined, "&")


def norm_url(c: Column) -> Column:
    """Comparison form of a URL: no scheme, fragment, trailing slash or campaign keys; host and path lower."""

    def normal(body: Column) -> Column:
        head = F.regexp_replace(F.substring_index(body, "?", 1), _SCHEME, "")
        query = F.when(F.instr(body, "?") > 0, clean_query(F.substring(body, F.instr(body, "?") + 1, F.length(body))))
        # Trailing slashes belong to the path; without a path they are the empty authority mark.
        place = F.rtrim(F.lower(head), F.lit("/"))
        marked = bind(F.coalesce(query, F.lit("")), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
        return F.concat(place, marked)

    return bind(_before_fragment(strip(F.coalesce(c, F.lit("")))), normal)


def host_path(c: Column) -> Column:
    """Lower-case host and path, the text that host and path rules look at."""
    return F.lower(F.regexp_replace(_after_scheme(c), "^//", ""))


def with_keys(url: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use(normalised url, host and path)`` with both computed once, also where Spark moves the result."""
    return bind(norm_url(url), lambda n: bind(host_path(n), lambda h: use(n, h)))


def url_host(c: Column) -> Column:
    return F.lower(authority(c))


def clean_link(c: Column, edge: str = ").,;]") -> Column:
    """Trim, drop punctuation of the sentence around the link, decode escapes."""
    return percent_decode(F.btrim(strip(c), F.lit(edge)))


# --- identifiers -------------------------------------------------------------------------------


def _id(c: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(c, pattern, group)
    return F.when(found != "", found)


def id_from_pdf_link(c: Column) -> Column:
    return _id(c, rules.PDF_ID_PATTERN)


def pdf_link_from_id(c: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/pdf/"), c, F.lit(".pdf"))


def canonical_pdf_link(c: Column) -> Column:
    """Any abstract, pdf or html link of a paper as its pdf link; other links lose query and fragment."""
    base = F.substring_index(F.substring_index(c, "#", 1), "?", 1)
    known = _id(base, rules.ANY_LINK_ID_PATTERN, 2)
    tail = F.element_at(F.split(base, "/html/"), 2)
    return (
        F.when(known.isNotNull(), pdf_link_from_id(known))
        .when(base.contains("arxiv.org/html/"), pdf_link_from_id(tail))
        .otherwise(base)
    )


def id_from_name(c: Column) -> Column:
    """Versioned id at the start of a file name."""
    return _id(c, rules.NAME_ID_PATTERN)


def id_from_ledger_link(c: Column) -> Column:
    """Versioned id of a ledger record; unversioned links give null."""
    return _id(strip(c), rules.LEDGER_ID_PATTERN)


def id_from_text(c: Column) -> Column:
    return _id(c, rules.FREE_ID_PATTERN)


# --- predicates over host + path ---------------------------------------------------------------


def github_release(hp: Column) -> Column:
    return hp.contains("github.com") & hp.contains("/releases")


def github_data_dir(hp: Column) -> Column:
    return hp.contains("github.com") & (hp.contains("/blob/main/data") | hp.contains("/tree/main/data"))


def is_dataset_url(norm: Column, hp: Column) -> Column:
    """Structural test: only links that look like a data set page or file enter the ledger."""
    accepted = (
        contains_any(hp, rules.DATA_HOSTS)
        | ends_with_any(norm, rules.DATA_ENDINGS)
        | github_release(hp)
        | github_data_dir(hp)
        | (hp.contains("github.com") & hp.contains("/data/"))
        | (hp.contains("kaggle.com") & hp.contains("/datasets/"))
    )
    return ~contains_any(hp, rules.REJECTED_HOSTS) & accepted


def host_allowed(url: Column, hosts: list[str] = rules.ALLOWED_HOSTS) -> Column:
    return contains_any(F.lower(url), hosts)


def on_preferred_host(hp: Column) -> Column:
    return contains_any(hp, rules.PREFERRED_HOSTS) | github_release(hp) | github_data_dir(hp)


def is_landing_page(url: Column) -> Column:
    """1 for a page, 0 for a link that ends like a data file."""
    return F.when(any_of([url.endswith(e) for e, _ in rules.FILE_ENDING_WEIGHTS]), 0).otherwise(1)


def host_class(hp: Column) -> Column:
    """Tie-break class of the rule pick, 5 best to 0."""
    result = None
    for rank, hosts in rules.HOST_CLASSES:
        test = contains_any(hp, hosts)
        result = F.when(test, rank) if result is None else result.when(test, rank)
    return (
        result.when(github_release(hp) | github_data_dir(hp), rules.HOST_CLASS_GITHUB)
        .when(hp.contains("storage.googleapis.com"), rules.HOST_CLASS_BUCKET)
        .when(hp.contains("drive.google.com"), rules.HOST_CLASS_DRIVE)
        .otherwise(0)
    )


def candidate_key(paper_link: Column, dataset_link: Column, link: Column | None = None) -> Column:
    """Identity of a search candidate: paper link, else data set link, else generic link."""
    options = [blank_to_null(paper_link), blank_to_null(dataset_link)]
    if link is not None:
        options.append(blank_to_null(link))
    return F.coalesce(*options, F.lit(""))


# --- safe names --------------------------------------------------------------------------------


def slug(c: Column, default: str = "model") -> Column:
    """Name usable as a folder: everything but letters, digits, dot, dash and underscore becomes ``_``."""
    safe = F.btrim(F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_"), F.lit("_"))
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(default))


def safe_title(c: Column) -> Column:
    """Title with every other character as ``_``."""
    return strip(F.regexp_replace(c, r"[^\p{L}\p{N} _-]", "_"))


def safe_file_name(c: Column) -> Column:
    """Title without the other characters."""
    return rstrip(F.regexp_replace(c, r"[^\p{L}\p{N} _-]", ""))


# --- links in text -----------------------------------------------------------------------------


def link_forms(text: Column) -> Column:
    """Distinct, sorted links of a LaTeX or plain text: href, url command and bare forms."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(r"\\href\{([^}]+)\}\{[^}]*\}"), 1),
        F.regexp_extract_all(text, F.lit(rules.URL_COMMAND_PATTERN), 1),
        F.regexp_extract_all(text, F.lit(rules.BARE_LINK_PATTERN), 1),
    )
    return F.array_sort(F.array_distinct(F.transform(found, lambda u: clean_link(u))))


def text_links(text: Column) -> Column:
    """Links of plain text without trailing punctuation."""
    found = F.regexp_extract_all(text, F.lit(rules.TEXT_LINK_PATTERN), 0)
    return F.transform(found, lambda u: F.rtrim(u, F.lit(".,;:)]}\"'")))


def best_link(texts: Column) -> Column:
    """The link of an array of texts whose domain ranks first, then the shortest, then the earliest."""
    links = F.filter(
        F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), text_links)),
        lambda u: ~F.lower(u).contains("arxiv.org"),
    )

    def keyed(u: Column, i: Column) -> Column:
        low = F.lower(u)
        rank = None
        for r, domain in enumerate(rules.DOMAIN_ORDER):
            rank = F.when(low.contains(domain), r) if rank is None else rank.when(low.contains(domain), r)
        return F.struct(rank.otherwise(999).alias("rank"), F.length(u).alias("len"), i.alias("pos"), u.alias("url"))

    return F.coalesce(F.array_min(F.transform(links, keyed))["url"], F.lit(""))
