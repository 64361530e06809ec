"""URL filter from path templates, in DataFrame operations only.

Per host a tree of path segments is built level by level. A segment that is an identifier, or one of many that
hardly repeat, becomes the wildcard ``*``. Of the others, branches whose labelled share of bad pages does not differ
significantly from the rest of their siblings merge into ``+``; the others keep their name. A template's purity, the
share of good labelled pages, is smoothed towards its host's and that towards the whole table's; templates
below the least purity are blocked. Explicit rules come first.

Urls are counted per (host, path) before the tree is built, and per (host, template, segment) within it, both by
partial aggregates: a host with a third of all pages is never gathered in one task.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise

CHECKED = 6  # levels of check_sql: at least as many as the deepest path it is used on has
UNITED = 32  # levels whose finished paths are written together
MANY = 8  # distinct segments from which rarely repeated ones count as variable
SIGNIFICANT = 1.96  # standard errors between a branch and its siblings
PRIOR = 8.0  # labelled pages that the smoothing is worth
LEAST_PURITY = 0.5
IDENTIFIER = "[0-9]"  # a segment with a digit names an item, not a section
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII capitals lowered) and path of a url; both empty without ``://`` or where null."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (size, rule, verdict) of the longest fitting rule; null without one."""
    fits = []
    for verdict, rule in rules:
        name, _, tail = rule.partition("/")
        fit = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        found = F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(fit, found))
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def segments(path: Column) -> Column:
    """Non-empty segments."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def templates(paths: DataFrame) -> DataFrame:
    """Add ``template`` to (host, path, pages, labelled, bad): one level of the tree at a time, down to the deepest path.

    A level only works on the paths that still have segments.
    """
    out = paths.withColumn("segs", segments(F.col("path"))).withColumn("template", F.lit(""))
    out = materialise(out, "paths")
    deepest = out.agg(F.max(F.size("segs"))).first()[0] or 0
    ended = None
    for level in range(deepest):
        short = out.where(F.size("segs") <= level).drop("segs")
        ended = ended.unionByName(short) if ended is not None else short
        if level % UNITED == UNITED - 1:
            ended = materialise(ended, "ended")
        out = out.where(F.size("segs") > level).withColumn("seg", F.col("segs")[level])
        branch = out.groupBy("host", "template", "seg")
        branch = materialise(branch.agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "bad")]), "branches")
        whole = branch.groupBy("host", "template").agg(
            F.sum("pages").alias("all_pages"), F.count(F.lit(1)).alias("kinds"),
            F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"),
        )
        variable = F.col("seg").rlike(IDENTIFIER) | ((F.col("kinds") >= MANY) & (F.col("pages") * 2 * F.col("kinds") < F.col("all_pages") + 3 * F.col("kinds")) & (F.col("pages") <= 2))
        rest, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        share = F.col("all_bad") / F.col("all_labelled")
        error = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / rest))
        differs = F.when(
            (F.col("labelled") > 0) & (rest > 0) & (F.col("all_bad") > 0) & (F.col("all_bad") < F.col("all_labelled")),
            F.abs(F.col("bad") / F.col("labelled") - rest_bad / rest) > SIGNIFICANT * error,
        ).otherwise(False)
        name = F.when(variable, "*").when(differs, F.col("seg")).otherwise("+")
        named = branch.join(whole, ["host", "template"]).select("host", "template", "seg", name.alias("name"))
        kept = ["host", "path", "pages", "labelled", "bad", "segs"]
        grown = F.concat("template", F.lit("/"), "name")
        grown_rows = out.join(named, ["host", "template", "seg"]).select(*kept, grown.alias("template"))
        out = materialise(grown_rows, "paths")  # each level reads the one before several times
    out = out.drop("segs")
    return ended.unionByName(out) if ended is not None else out


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    prior: float = PRIOR,
    least_purity: float = LEAST_PURITY,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, template, purity, verdict) for every row of ``pages``.

    ``labels`` (doc_id, quality, toxic) marks the page of the same id as bad where any of its rows has quality 0 or
    toxic 1; null marks are not bad, null ids label nothing. A url that is null or has no ``://`` has an empty host
    and path, which form a host of their own. rule is the longest fitting rule, whose verdict holds; else a template
    is blocked where its smoothed purity is below ``least_purity``. Without labels the purity is 1. Repeated
    rows get the same verdict; other columns are not read.
    """
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.col("quality") == 0, F.col("toxic") == 1, F.lit(False))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(bad.cast("long")).alias("bad"))
    counted = rows.join(marks, "page_id", "left").groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    placed = templates(counted)
    good = F.sum(F.col("labelled") - F.col("bad"))
    sums = placed.groupBy("host", "template").agg(F.sum("labelled").alias("n"), good.alias("good"))
    by_host = sums.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    overall = by_host.agg(F.coalesce(F.sum("host_good") / F.nullif(F.sum("host_n"), F.lit(0)), F.lit(1.0)).alias("base"))
    host_purity = (F.col("host_good") + prior * F.col("base")) / (F.col("host_n") + prior)
    scored = sums.join(by_host.join(F.broadcast(overall)), "host")  # one row of totals
    scored = scored.select("host", "template", ((F.col("good") + prior * host_purity) / (F.col("n") + prior)).alias("purity"))
    verdicts = placed.join(scored, ["host", "template"]).select("host", "path", "template", "purity")
    found = rule_of(F.col("host"), F.col("path"), rules)
    judged = rows.join(verdicts, ["host", "path"]).withColumn("_found", found)
    method = F.when(F.col("purity") < least_purity, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("_found.rule").alias("rule"), "template", "purity", F.coalesce("_found.verdict", method).alias("verdict")
    )


def check_sql(depth: int = CHECKED, rules: Sequence[tuple[str, str]] = RULES, prior: float = PRIOR, least_purity: float = LEAST_PURITY) -> str:
    """The same over tables pages and labels, for DuckDB."""
    fits = ", ".join(
        f"case when (host = '{n}' or host like '%.{n}') and starts_with(path, '/{t}') then {{'size': {len(r)}, 'rule': '{r}', 'verdict': '{v}'}} end"
        for v, r in rules
        for n, _, t in [r.partition("/")]
    )
    parts = [
        """rest as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as x from pages)""",
        """cut as (select page_id, regexp_extract(x, '^[^/?#]*') as h, x from rest)""",
        f"""urls as (select page_id, translate(h, '{string.ascii_uppercase}', '{string.ascii_lowercase}') as host,
            regexp_extract(substr(x, length(h) + 1), '^[^?#]*') as path from cut)""",
        """marks as (select doc_id as page_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad
            from labels where doc_id is not null group by 1)""",
        """counted as (select host, path, count(*) as pages, count(bad) as labelled, coalesce(sum(bad), 0) as bad
            from urls left join marks using (page_id) group by 1, 2)""",
        f"""t0 as (select *, '' as template, case when len(e) <= {depth} then e
            else list_append(e[1:{depth - 1}], array_to_string(e[{depth}:], '/')) end as segs
            from (select *, list_filter(string_split(path, '/'), lambda s: s <> '') as e from counted))""",
    ]
    for k in range(depth):
        parts += [
            f"s{k} as (select host, path, pages, labelled, bad, segs, template, segs[{k + 1}] as seg from t{k})",
            f"""b{k} as (select host, template, seg, sum(pages) as pages, sum(labelled) as labelled, sum(bad) as bad
                from s{k} where seg is not null group by 1, 2, 3)""",
            f"""w{k} as (select host, template, sum(pages) as ap, count(*) as kinds, sum(labelled) as al, sum(bad) as ab
                from b{k} group by 1, 2)""",
            f"""n{k} as (select host, template, seg, case
                when regexp_matches(seg, '{IDENTIFIER}') or (kinds >= {MANY} and pages * 2 * kinds < ap + 3 * kinds and pages <= 2) then '*'
                when labelled > 0 and al > labelled and ab > 0 and ab < al and abs(bad / labelled - (ab - bad) / (al - labelled))
                    > {SIGNIFICANT} * sqrt((ab / al) * (1 - ab / al) * (1 / labelled + 1 / (al - labelled))) then seg
                else '+' end as name from b{k} join w{k} using (host, template))""",
            f"""t{k + 1} as (select host, path, pages, labelled, bad, segs,
                case when seg is null then template else template || '/' || name end as template
                from s{k} left join n{k} using (host, template, seg))""",
        ]
    parts += [
        f"sums as (select host, template, sum(labelled) as n, sum(labelled - bad) as good from t{depth} group by 1, 2)",
        "hosts as (select host, sum(n) as hn, sum(good) as hg from sums group by 1)",
        "total as (select coalesce(sum(hg) / nullif(sum(hn), 0), 1.0) as base from hosts)",
        f"""scored as (select host, template, (good + {prior} * ((hg + {prior} * base) / (hn + {prior}))) / (n + {prior}) as purity
            from sums join hosts using (host), total)""",
        f"found as (select *, list_max(list_filter([{fits}], lambda f: f is not null)) as f from urls)",
    ]
    parts = [p.replace(" as (", " as materialized (", 1) for p in parts]
    return f"""with {', '.join(parts)}
        select page_id, host, path, f.rule as rule, template, round(purity, 9) as purity,
            coalesce(f.verdict, case when purity < {least_purity} then 'block' else 'allow' end) as verdict
        from found join t{depth} using (host, path) join scored using (host, template)"""
