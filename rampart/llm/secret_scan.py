"""Secret scans: three base patterns, and strings that a character Markov model finds more like random strings than like ordinary identifiers.

Both models are first-order, trained on all documents: the random one on the values that the base patterns
find, mixed with a uniform one; the other on all other identifier-like strings.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import quoted, quoted_name

#: The base patterns, in the order of their kinds. Those of access and hex are written with their
#: least lengths; a run too short to pass holds no passing match, so the matches are the same.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]"
_SIZE = len(ALPHABET) + 1  # and the start of a string
_BLOCK = 256


@dataclass(frozen=True)
class SecretParams:
    """Strings of at least ``least`` characters are scored; ordinary ones of at least ``train_least`` are learnt from.
    A string is a secret from ``threshold`` nats a character on; one character counts at most ``most`` either way."""

    least: int = 20
    train_least: int = 12
    threshold: float = 0.5
    most: float = 3.0
    smoothing: float = 20.0


_NO_MATCHES = "cast(array() as array<struct<start: int, end: int, match: string>>)"


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _pieces(text: Column, pattern: str) -> Column:
    """What precedes each match, with the match, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("skip"), m.alias("match")))


def _placed(pieces: Column) -> Column:
    """The matches of some pieces in a row and where the last of them ends, counted from where the first piece begins."""
    return F.aggregate(
        pieces, F.struct(F.lit(0).alias("at"), F.expr(_NO_MATCHES).alias("out")),
        lambda s, x: F.struct((s["at"] + x["skip"] + F.length(x["match"])).alias("at"), F.concat(s["out"], F.array(F.struct(
            (s["at"] + x["skip"]).alias("start"), (s["at"] + x["skip"] + F.length(x["match"])).alias("end"), x["match"].alias("match")))).alias("out")))


def _matches(text: Column, pattern: str) -> Column:
    """start, end (code points, end exclusive) and text of every match.

    Positions are added up inside blocks of ``_BLOCK`` matches, then over the blocks, so that no array grows with
    all matches of a text one by one.
    """

    def located(pieces: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _BLOCK).cast("int")), lambda i: _placed(F.slice(pieces, i * _BLOCK + 1, F.lit(_BLOCK))))
        begins = lambda done: F.aggregate(done, F.expr("array(0)"), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x["at"])))
        moved = lambda done, at: F.flatten(F.transform(done, lambda x, i: F.transform(x["out"], lambda m: F.struct(
            (m["start"] + F.get(at, i)).alias("start"), (m["end"] + F.get(at, i)).alias("end"), m["match"].alias("match")))))
        return _bound(blocks, lambda done: _bound(begins(done), lambda at: moved(done, at)))

    return F.when(text.rlike(pattern), _bound(_pieces(text, pattern), located)).otherwise(F.expr(_NO_MATCHES))


def _blanked(text: Column, pattern: str, is_span=lambda match: F.lit(True)) -> Column:
    """The text with blanks, as many as it has characters, for every match that ``is_span`` holds for."""

    def blank(found: Column) -> Column:
        instead = F.transform(found, lambda m: F.when(is_span(m), F.repeat(F.lit(" "), F.length(m))).otherwise(m))
        return F.array_join(F.flatten(F.zip_with(F.split(text, pattern, -1), instead, lambda b, m: F.array(b, F.coalesce(m, F.lit(""))))), "")

    return F.when(text.rlike(pattern), _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), blank)).otherwise(text)


def _of_kind(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].cast("int").alias("start"), F.lit(kind).alias("kind"), m["end"].cast("int").alias("end")))


def _assign_value(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 2)


def _is_assign(match: Column) -> Column:
    return F.length(_assign_value(match)) >= ASSIGN_LEAST


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end) of the base patterns, by start, then kind."""
    assign = F.filter(_matches(text, ASSIGN), lambda m: _is_assign(m["match"]))
    return F.sort_array(F.concat(_of_kind(assign, 0), _of_kind(_matches(text, ACCESS), 1), _of_kind(_matches(text, HEX), 2)))


def model(docs: DataFrame, text: str = "text", params: SecretParams = SecretParams()) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random over ordinary; at most 68 x 68 counts a class come to the driver."""
    value = quoted(docs, text).cast("string")
    rows = docs.select(F.coalesce(value, F.lit("")).alias("text"))
    any_base = F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}")
    values = F.filter(F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0))), lambda v: F.length(v) >= params.train_least)
    rest = F.when(any_base, F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, "\n"), ACCESS, "\n"), HEX, "\n")).otherwise(F.col("text"))
    strings = rows.select(F.lit(1).alias("kind"), F.explode(F.regexp_extract_all(rest, F.lit(f"{RUN}{{{params.train_least},}}"), F.lit(0))).alias("s")).unionByName(
        rows.filter(any_base).select(F.lit(0).alias("kind"), F.explode(values).alias("s")))
    letters_of = strings.select("kind", F.array_remove(F.split("s", ""), "").alias("chars"))
    pairs = letters_of.select("kind", F.explode(F.transform("chars", lambda c, i: F.concat(F.coalesce(F.get("chars", i - 1), F.lit("^")), c))).alias("pair"))
    counts: dict[int, dict[str, int]] = {0: {}, 1: {}}
    letters = set(ALPHABET)
    for r in pairs.filter(F.col("pair").rlike(f"^(?:{RUN}|\\^){RUN}$")).groupBy("kind", "pair").count().collect():
        if r["pair"][1] in letters:
            counts[r["kind"]][r["pair"]] = r["count"]
    alone = []  # a context seen rarely falls back on how often characters occur at all
    for k in (0, 1):
        of = {b: sum(counts[k].get(a + b, 0) for a in "^" + ALPHABET) for b in ALPHABET}
        alone.append({b: (n + 1) / (sum(of.values()) + len(ALPHABET)) for b, n in of.items()})
    table = []
    for a in "^" + ALPHABET:
        total = [sum(counts[k].get(a + b, 0) for b in ALPHABET) for k in (0, 1)]
        table.append(0.0)
        for b in ALPHABET:
            chance = [(counts[k].get(a + b, 0) + params.smoothing * alone[k][b]) / (total[k] + params.smoothing) for k in (0, 1)]
            ratio = math.log(0.5 / len(ALPHABET) + 0.5 * chance[0]) - math.log(chance[1])
            table.append(max(-params.most, min(params.most, ratio)))
    return table


def _score(s: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's characters."""
    cells = F.expr("array(" + ",".join(f"{x!r}D" for x in table) + ")")
    summed = F.aggregate(
        F.array_remove(F.split(s, ""), ""), F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(F.instr(F.lit(ALPHABET), c).alias("before"), (acc["sum"] + F.element_at(cells, acc["before"] * _SIZE + F.instr(F.lit(ALPHABET), c) + 1)).alias("sum")),
        lambda acc: acc["sum"] / F.length(s),
    )
    return summed


def added_spans(text: Column, table: list[float], params: SecretParams = SecretParams()) -> Column:
    """Array of (start, kind, end) of the strings that the models call random.

    Base spans are blanked first, so what stands beside one in the same run is scored for itself. Only where base
    spans of two kinds overlap may an added span lie in what is left of one of them.
    """
    has_base = text.rlike(f"{ASSIGN}|{ACCESS}|{HEX}")
    rest = _bound(_blanked(text, ASSIGN, _is_assign), lambda t: _bound(_blanked(t, ACCESS), lambda u: _blanked(u, HEX)))
    found = _bound(F.when(has_base, rest).otherwise(text), lambda t: _matches(t, f"{RUN}{{{params.least},}}"))
    return _of_kind(F.filter(found, lambda m: _score(m["match"], table) >= params.threshold), 3)


def _joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, table: list[float], id_col: str = "doc_id", text: str = "text", params: SecretParams = SecretParams()) -> DataFrame:
    """id, ``base`` and ``spans`` of every row: arrays of (start, kind number, end), by start, then kind; a null text has none."""
    rows = docs.select(quoted(docs, id_col).alias("id"), F.coalesce(quoted(docs, text).cast("string"), F.lit("")).alias("text"))
    based = rows.select("id", "text", base_spans(F.col("text")).alias("base"))
    return based.select(F.col("id").alias(id_col), "base", F.sort_array(F.concat("base", added_spans(F.col("text"), table, params))).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, table: list[float], text: str = "text", mark: str = "[SECRET]", params: SecretParams = SecretParams()) -> DataFrame:
    """The rows of ``docs`` with every span of ``text`` replaced by ``mark``; overlapping spans by one. A null text stays null.

    Where there is a column n_chars, it is the new length for the texts that change.
    """
    value = quoted(docs, text).cast("string")
    base = base_spans(value)
    spans = F.sort_array(F.concat(base, added_spans(value, table, params)))
    made = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], F.when(x["start"] >= s["at"], F.concat(F.substring(value, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(F.lit(""))).alias("out")),
        lambda s: F.concat(s["out"], F.substring(value, s["at"] + 1, F.length(value))),
    )
    changed = F.when(value.rlike(f"{ASSIGN}|{ACCESS}|{HEX}|{RUN}{{{params.least},}}"), made).otherwise(value)
    out = docs.select(*(changed.alias(c) if c == text else quoted_name(c) for c in docs.columns))
    if "n_chars" in docs.columns and text != "n_chars":
        kind = docs.schema["n_chars"].dataType
        new = F.length(quoted_name(text)).cast(kind)
        old = changed != value
        out = docs.select(*(changed.alias(c) if c == text else F.when(old, F.length(changed).cast(kind)).otherwise(quoted_name(c)).alias(c) if c == "n_chars" else quoted_name(c) for c in docs.columns))
    return out
