"""Additive link scores with their reasons, from constant weight tables."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlode import rules
from paperlode.functions.basic import contains_any, ends_with_any
from paperlode.functions.urls import github_data_dir, github_release


def _hits(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def _word_hits(text: Column, words: list[str]) -> Column:
    return reduce(
        lambda a, b: a + b,
        [text.rlike(rf"(?<![\p{{L}}\p{{N}}_]){w}(?![\p{{L}}\p{{N}}_])").cast("int") for w in words],
    )


def link_score_parts(norm: Column, hp: Column, text: Column, whole_words: bool = False) -> list[tuple[str, Column]]:
    """(reason, points or null) of every rule, in reporting order.

    ``norm`` is the normalised URL, ``hp`` its host and path, ``text`` anchor and context in lower case.
    """
    parts: list[tuple[str, Column]] = []

    def rule(reason: str, test: Column, points: Column | int) -> None:
        parts.append((reason, F.when(test, points)))

    for host, weight in rules.HOST_WEIGHTS[:-1]:
        rule(f"host+:{host}", hp.contains(host), weight)
    rule("host+:github.com/", hp.startswith("github.com/"), 0)
    rule("host+:gh_releases", github_release(hp), rules.GITHUB_RELEASE_WEIGHT)
    rule("host+:gh_data_dir", github_data_dir(hp), rules.GITHUB_DATA_DIR_WEIGHT)
    raw_host, raw_weight = rules.HOST_WEIGHTS[-1]
    rule(f"host+:{raw_host}", hp.contains(raw_host), raw_weight)
    for host, weight in rules.HOST_PENALTIES:
        rule(f"host-:{host}", hp.contains(host), weight)
    inside_repo = github_release(hp) | github_data_dir(hp) | hp.contains("/data/")
    rule("gh_repo_root", hp.contains("github.com") & ~inside_repo, rules.REPO_ROOT_PENALTY)
    for path, weight in rules.PATH_WEIGHTS:
        rule(f"path:{path}", hp.contains(path), weight)
    earlier = F.lit(False)
    for ending, weight in rules.FILE_ENDING_WEIGHTS:
        rule(f"ext:{ending}", norm.endswith(ending) & ~earlier, weight)
        earlier = earlier | norm.endswith(ending)
    good = _hits(text, rules.POSITIVE_WORDS)
    bad = (_word_hits if whole_words else _hits)(text, rules.NEGATIVE_WORDS)
    rule("kw_pos", good > 0, F.least(F.lit(rules.POSITIVE_CAP), good * rules.WORD_STEP))
    rule("kw_neg", bad > 0, -F.least(F.lit(rules.NEGATIVE_CAP), bad * rules.WORD_STEP))
    for first, second in rules.NEGATIVE_PHRASES:
        rule("kw_neg_phrase", text.contains(first) & text.contains(second), rules.PHRASE_PENALTY)
    return parts


def total_points(parts: list[tuple[str, Column]]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for _, p in parts]).cast("int")


def named_points(parts: list[tuple[str, Column]]) -> Column:
    """"reason:points" of the rules that apply; a rule that does not is null and drops out."""
    named = [F.concat(F.lit(name + ":"), p.cast("string")) for name, p in parts]
    return F.filter(F.array(*named), lambda r: r.isNotNull())


def link_score(norm: Column, hp: Column, text: Column, whole_words: bool = False) -> Column:
    return total_points(link_score_parts(norm, hp, text, whole_words))


def link_reasons(norm: Column, hp: Column, text: Column, whole_words: bool = False) -> Column:
    return named_points(link_score_parts(norm, hp, text, whole_words))


def basic_link_score_parts(norm: Column, hp: Column, text: Column) -> list[tuple[str, Column]]:
    """Rules of the older score: one point group per kind of evidence."""
    inside_repo = hp.contains("/releases") | hp.contains("/data") | github_data_dir(hp)
    return [
        ("host_hint", F.when(contains_any(hp, rules.DATA_HOSTS), 5)),
        ("path_hint", F.when(contains_any(hp, rules.DATA_PATHS), 3)),
        ("file_ext", F.when(ends_with_any(norm, rules.DATA_ENDINGS), 3)),
        ("neg_host", F.when(contains_any(hp, rules.REJECTED_HOSTS), -3)),
        ("github_repo_root", F.when(hp.contains("github.com") & ~inside_repo, -3)),
        ("ctx_pos", F.when(contains_any(text, rules.CONTEXT_WORDS), 3)),
        ("ctx_neg", F.when(contains_any(text, rules.CONTEXT_ANTI_WORDS), -2)),
    ]


def basic_link_score(norm: Column, hp: Column, text: Column) -> Column:
    return total_points(basic_link_score_parts(norm, hp, text))


def basic_link_reasons(norm: Column, hp: Column, text: Column) -> Column:
    named = [F.when(p.isNotNull(), F.lit(name)) for name, p in basic_link_score_parts(norm, hp, text)]
    return F.filter(F.array(*named), lambda r: r.isNotNull())
