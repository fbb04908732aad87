"""Judging addresses by rules and, where no rule fits, by the ratio of two character language models.

The models are Markov models of variable order over the characters of host and path: counts of all n-grams of the
addresses that rules accept and of those they reject, smoothed from order to order by the number of different
successors (Witten-Bell), down to a uniform character. They are tables, joined to the addresses' n-grams; nothing
of them is collected, so they may grow with the corpus. An address scores the difference of its two log-likelihoods,
divided by its length; the threshold is the one that separates best the judged addresses of a fold left out of the counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from speechloom.plans.blocks import checkpointed

ORDER = 4
ALPHABET = 257
FOLDS = 5
BIN = 0.05
BINS = 100
START, END = "\x02", "\x03"


@dataclass(frozen=True)
class UrlRule:
    """``host`` and its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    UrlRule("org", "/", True), UrlRule("example.org", "/es/", False), UrlRule("example.org", "/en/1", False),
    UrlRule("com", "/fr/", True), UrlRule("com", "/de/", False),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, in lower case, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, allow = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.allow).otherwise(allow)
    return name, allow


def gram_table(grams: DataFrame, order: int) -> DataFrame:
    """``gram, accepted, rejected``: smoothed probabilities of the last character of each n-gram given those before.

    A row of ``grams`` stands for ``_times`` equal ones, without that column for itself.
    """
    rows_of = F.col("_times") if "_times" in grams.columns else F.lit(1).cast("bigint")
    times = lambda known: F.coalesce(F.sum(F.when(F.col("known") == F.lit(known), rows_of)), F.lit(0).cast("bigint"))
    counts = checkpointed(grams.groupBy("gram").agg(times(True).alias("a"), times(False).alias("r")))
    below = None
    for k in range(order + 1):
        key = F.substr("gram", F.length("gram") - k)
        rows = counts.groupBy(key.alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        given = Window.partitionBy("_ctx")
        rows = rows.withColumn("_ctx", F.substring("gram", 1, k)).select(
            "gram", "a", "r", *[x for c in "ar" for x in (
                F.sum(c).over(given).alias("n" + c), F.sum((F.col(c) > 0).cast("bigint")).over(given).alias("d" + c))])
        if below is None:
            rows = rows.withColumns({"pa": F.lit(1.0 / ALPHABET), "pr": F.lit(1.0 / ALPHABET)})
        else:
            rows = rows.withColumn("_less", F.substr("gram", F.lit(2))).join(
                below.select(F.col("gram").alias("_less"), "pa", "pr"), "_less")
        smooth = lambda c: F.when(F.col("n" + c) == 0, F.col("p" + c)).otherwise(
            (F.col(c) + F.col("d" + c) * F.col("p" + c)) / (F.col("n" + c) + F.col("d" + c))).alias("p" + c)
        below = checkpointed(rows.select("gram", smooth("a"), smooth("r")))
    return below.select("gram", F.col("pa").alias("accepted"), F.col("pr").alias("rejected"))


def threshold(scores: DataFrame) -> float:
    """The grid value with the best sum of true rates on ``score, allow``; of ties the nearest to 0, then the smaller.

    Only the bins of a histogram reach the driver. Without judged addresses of both kinds it is 0.
    """
    place = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.round("score", 9) / BIN))).cast("int")
    bins = {r["b"]: (r["y"], r["n"]) for r in scores.groupBy(place.alias("b")).agg(
        F.count_if("allow").alias("y"), F.count_if(~F.col("allow")).alias("n")).collect()}
    yes, no = sum(y for y, _ in bins.values()), sum(n for _, n in bins.values())
    if not yes or not no:
        return 0.0
    best, kept, dropped = None, yes, 0
    for b in range(-BINS, BINS + 1):
        # Threshold b * BIN accepts the bins from b on.
        quality = -(kept * no + dropped * yes), abs(b), b
        best = quality if best is None else min(best, quality)
        y, n = bins.get(b, (0, 0))
        kept, dropped = kept - y, dropped + n
    return best[2] * BIN


def judged_urls(pages: DataFrame, rules: Sequence[UrlRule] = RULES, order: int = ORDER) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row.

    ``score`` is the log-likelihood difference per character; without a rule an address is allowed when it reaches the calibrated threshold.
    Null addresses and those without ``://`` have empty host and path and are scored like an empty address. Repeated rows count and
    are judged each; null ids are kept. Other columns are not read; an empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    parted = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    name, allow = longest_rule(F.col("host"), F.col("path"), rules)
    whole = F.concat("host", "path")
    fold = F.conv(F.substring(F.md5(whole), 1, 8), 16, 10).cast("bigint") % FOLDS
    urls = checkpointed(parted.withColumns({"rule": name, "allow": allow, "whole": whole, "fold": fold}))
    # Equal addresses are scored once.
    texts = urls.groupBy("whole", "fold").agg(F.first("allow").alias("allow"), F.count("*").alias("_times"))
    padded = F.concat(F.lit(START * order), F.col("whole"), F.lit(END))
    texts = texts.select(
        "whole", F.when(F.col("fold") > 0, F.col("allow")).alias("known"), "_times",
        F.explode(F.transform(F.sequence(F.lit(1), F.length("whole") + 1), lambda i: F.substr(padded, i, F.lit(order + 1)))).alias("gram"))
    table = gram_table(texts, order)  # a repeated address counts as often as it stands there
    gain = F.sum(F.ln("accepted") - F.ln("rejected")) / (F.length("whole") + 1)
    scores = checkpointed(texts.select("whole", "gram").join(table, "gram").groupBy("whole").agg(gain.alias("score")))
    scored = urls.join(scores, "whole")
    least = threshold(scored.where("allow is not null and fold = 0"))
    passes = F.coalesce("allow", F.round("score", 9) >= F.lit(least))
    return scored.select("page_id", "host", "path", "rule", F.when(passes, "allow").otherwise("block").alias("verdict"), "score")


def url_verdicts(pages: DataFrame) -> DataFrame:
    """The registered query."""
    return judged_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _levels() -> str:
    """SQL of the smoothed tables, order by order."""
    out = []
    for k in range(ORDER + 1):
        out.append(f"""
k{k} AS (
  SELECT g AS gram, sum(a) AS a, sum(r) AS r FROM (SELECT right(gram, {k + 1}) AS g, a, r FROM counts) GROUP BY 1),
w{k} AS (
  SELECT gram, a, r, sum(a) OVER c AS na, sum(r) OVER c AS nr, sum((a > 0)::INT) OVER c AS da, sum((r > 0)::INT) OVER c AS dr
  FROM k{k} WINDOW c AS (PARTITION BY substr(gram, 1, {k}))),
p{k} AS (
  SELECT w.gram, CASE WHEN na = 0 THEN b.pa ELSE (a + da * b.pa) / (na + da) END AS pa,
         CASE WHEN nr = 0 THEN b.pr ELSE (r + dr * b.pr) / (nr + dr) END AS pr
  FROM w{k} w JOIN {f"p{k - 1} b ON b.gram = substr(w.gram, 2)" if k else f"(SELECT 1.0::DOUBLE / {ALPHABET} AS pa, 1.0::DOUBLE / {ALPHABET} AS pr) b ON true"})""")
    return ",".join(out)


def _rule_sql(value) -> str:
    cases = "".join(
        f" WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {value(r)}"
        for r in sorted(RULES, key=lambda r: -len(r.name)))
    return f"CASE{cases} END"


ORACLE = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
urls AS (
  SELECT *, {_rule_sql(lambda r: f"'{r.name}'")} AS rule, {_rule_sql(lambda r: str(r.allow).lower())} AS allow,
         host || path AS whole, ('0x' || substr(md5(host || path), 1, 8))::BIGINT % {FOLDS} AS fold FROM split),
padded AS (
  SELECT page_id, allow, fold, whole, repeat(chr(2), {ORDER}) || whole || chr(3) AS text FROM urls),
grams AS (
  SELECT page_id, whole, CASE WHEN fold > 0 THEN allow END AS known, substr(text, i, {ORDER + 1}) AS gram
  FROM (SELECT *, unnest(range(1, length(whole) + 2)) AS i FROM padded)),
counts AS (
  SELECT gram, count(*) FILTER (WHERE known) AS a, count(*) FILTER (WHERE NOT known) AS r FROM grams GROUP BY gram),
{_levels()},
scores AS (
  SELECT whole, sum(ln(pa) - ln(pr)) / (length(whole) + 1) AS score
  FROM (SELECT DISTINCT whole, i, substr(text, i, {ORDER + 1}) AS gram
        FROM (SELECT whole, text, unnest(range(1, length(whole) + 2)) AS i FROM (SELECT DISTINCT whole, text FROM padded)))
  JOIN p{ORDER} USING (gram) GROUP BY whole),
scored AS (SELECT urls.*, round(score, 9) AS score FROM urls JOIN scores USING (whole)),
bins AS (
  SELECT greatest(-{BINS}, least({BINS}, floor(score / {BIN}::DOUBLE)))::INT AS b, count(*) FILTER (WHERE allow) AS y, count(*) FILTER (WHERE NOT allow) AS n
  FROM scored WHERE allow IS NOT NULL AND fold = 0 GROUP BY 1),
grid AS (SELECT unnest(range(-{BINS}, {BINS + 1})) AS b),
curve AS (
  SELECT grid.b, coalesce(sum(y) FILTER (WHERE bins.b >= grid.b), 0) AS kept, coalesce(sum(n) FILTER (WHERE bins.b < grid.b), 0) AS dropped,
         coalesce(sum(y), 0) AS yes, coalesce(sum(n), 0) AS no
  FROM grid LEFT JOIN bins ON true GROUP BY grid.b),
cut AS (SELECT CASE WHEN yes = 0 OR no = 0 THEN 0.0 ELSE b * {BIN}::DOUBLE END AS t FROM curve
  ORDER BY kept * no + dropped * yes DESC, abs(b), b LIMIT 1)
SELECT page_id, host, path, rule, CASE WHEN coalesce(allow, score >= t) THEN 'allow' ELSE 'block' END AS verdict
FROM scored, cut
"""
