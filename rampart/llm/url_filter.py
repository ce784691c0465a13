"""URL filters: host and path rules, and for the rest a ratio of character language models.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, give each character of a URL
a probability after the longest context seen; the mean log ratio, against a calibrated threshold, decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import Shared, quoted

#: Symbols of the models, numbered from 1; any other character is ``*`` and the start of a URL is number 0. Digits are one symbol.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0.-/*"
_BASE = 32


@dataclass(frozen=True)
class Rule:
    """A rule for a host and its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class RatioParams:
    """Contexts of up to ``order`` characters, so at most 32^(order + 1) rows of the model table (2^20, 12 bytes each, at 3): the bound of what is broadcast.
    Scores are calibrated in ``bins`` steps between -``most`` and ``most`` nats a character."""

    order: int = 3
    bins: int = 400
    most: float = 4.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``, or for null."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Text and verdict of the longest rule that fits; null if none does. Of equal lengths the earlier rule wins."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):  # the longest is tested first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _numbers(text: Column) -> Column:
    """Symbol numbers of the characters."""
    symbols = F.regexp_replace(F.translate(F.lower(text), "123456789", "000000000"), "[^a-z0./-]", "*")
    return F.transform(F.array_remove(F.split(symbols, ""), ""), lambda c: F.instr(F.lit(SYMBOLS), c))


def _codes(numbers: Column, order: int) -> Column:
    """For each character the number of the context before it and itself, in base 32."""
    at = lambda i: F.coalesce(F.get(numbers, i), F.lit(0))
    return F.transform(numbers, lambda x, i: sum((at(i - k) * _BASE**k for k in range(1, order + 1)), x))


def ratio_table(labelled: DataFrame, shared: Shared, params: RatioParams = RatioParams()) -> DataFrame:
    """``code``, ``ratio``: the log ratio of accepted over rejected for every context and character.

    ``labelled`` has ``codes`` (of a URL) and ``accepted``. Witten-Bell: the weight of the next shorter context is
    the number of different characters seen after this one; the shortest falls back on equal chances.
    """
    grams = labelled.select("accepted", F.explode("codes").alias("code")).groupBy("code").agg(
        F.count(F.when(F.col("accepted"), 1)).alias("n1"), F.count(F.when(~F.col("accepted"), 1)).alias("n0"))
    grams = shared.save(grams, "grams")  # at most 32^(order + 1) rows
    out = labelled.sparkSession.range(_BASE ** (params.order + 1)).select(F.col("id").cast("int").alias("code"), F.lit(1.0 / _BASE).alias("p0"), F.lit(1.0 / _BASE).alias("p1"))
    for k in range(params.order + 1):  # contexts of k characters
        size = _BASE ** (k + 1)
        short = grams.select((F.col("code") % size).alias("gram"), "n0", "n1").groupBy("gram").agg(F.sum("n0").alias("g0"), F.sum("n1").alias("g1"))
        context = short.groupBy(F.floor(F.col("gram") / _BASE).cast("int").alias("context")).agg(
            *(F.sum(f"g{c}").alias(f"c{c}") for c in (0, 1)), *(F.count(F.when(F.col(f"g{c}") > 0, 1)).alias(f"t{c}") for c in (0, 1)))
        out = out.withColumn("gram", F.col("code") % size).withColumn("context", F.floor(F.col("gram") / _BASE).cast("int"))
        out = out.join(F.broadcast(short), "gram", "left").join(F.broadcast(context), "context", "left")
        for c in (0, 1):
            seen = F.coalesce(F.col(f"c{c}"), F.lit(0)) > 0
            out = out.withColumn(f"p{c}", F.when(seen, (F.coalesce(F.col(f"g{c}"), F.lit(0)) + F.col(f"t{c}") * F.col(f"p{c}")) / (F.col(f"c{c}") + F.col(f"t{c}"))).otherwise(F.col(f"p{c}")))
        out = out.select("code", "p0", "p1")
    return out.select("code", F.log(F.col("p1") / F.col("p0")).alias("ratio"))


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url: str = "url", params: RatioParams = RatioParams()) -> DataFrame:
    """``pages`` id and url with host, path, rule, verdict and ``score``, one row per row.

    URLs that a rule allows or blocks train the models, half of them (by a hash of host and path); the other half
    sets the threshold where the sum of both error rates is least (the middle of equal ones). A URL without
    host and path, or one that no labelled URLs of both kinds help to judge, has score 0 and is allowed.
    """
    rows = pages.select(quoted(pages, id_col).alias("id"), quoted(pages, url).cast("string").alias("url"))
    split = rows.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = split.withColumn("by", rule_of(F.col("host"), F.col("path"), rules)).withColumn("numbers", _numbers(F.concat("host", "path"))).withColumn("codes", _codes(F.col("numbers"), params.order)).drop("numbers")
    ruled = ruled.withColumn("train", F.pmod(F.xxhash64("host", "path"), F.lit(2)) == 0)
    labelled = ruled.filter("by is not null").select("codes", "train", (F.col("by.verdict") == "allow").alias("accepted"))
    shared = Shared(pages.sparkSession, "urls")
    table = F.broadcast(shared.save(ratio_table(labelled.filter("train"), shared, params), "ratios"))

    def scored(frame: DataFrame, *keep: str) -> DataFrame:
        marked = frame.withColumn("row", F.monotonically_increasing_id())
        each = marked.select("row", *keep, F.explode_outer("codes").alias("code")).join(table, "code", "left")
        return each.groupBy("row", *keep).agg(F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("score"))

    tuned = scored(labelled.filter(~F.col("train")), "accepted")
    step = 2 * params.most / params.bins
    binned = tuned.groupBy(F.least(F.greatest(F.floor((F.col("score") + params.most) / step), F.lit(0)), F.lit(params.bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.when(F.col("accepted"), 1)).alias("good"), F.count(F.when(~F.col("accepted"), 1)).alias("bad"))
    threshold = _threshold({r["bin"]: (r["good"], r["bad"]) for r in binned.collect()}, params)
    kept = scored(ruled, "id", "url", "host", "path", "by")
    method = F.when(F.col("score") >= threshold, "allow").otherwise("block") if threshold is not None else F.lit("allow")
    method = F.when((F.length("host") == 0) & (F.length("path") == 0), "allow").otherwise(method)
    return kept.select(F.col("id").alias(id_col), F.col("url").alias(url), "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", method).alias("verdict"), "score")


def _threshold(counts: dict[int, tuple[int, int]], params: RatioParams) -> float | None:
    """The score below which URLs are rejected, from at most ``bins`` counts; none without URLs of both kinds."""
    good, bad = (sum(c[k] for c in counts.values()) for k in (0, 1))
    if not good or not bad:
        return None
    errors, lost, stopped = [], 0, 0
    for i in range(params.bins + 1):
        errors.append(lost / good + (bad - stopped) / bad)
        lost, stopped = lost + counts.get(i, (0, 0))[0], stopped + counts.get(i, (0, 0))[1]
    best = [i for i, e in enumerate(errors) if e == min(errors)]
    return best[len(best) // 2] * 2 * params.most / params.bins - params.most
