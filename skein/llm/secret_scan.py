"""Secrets in texts: patterns, and strings whose characters are too mixed to be words.

All in SQL functions. Each pattern is found by splitting the text at it: the lengths of the pieces
and of the matches give places in code points. Strings of one character class (hexadecimal digits,
letters with digits) are candidates. A window slides over each; the counts of its characters change
by the one that enters and the one that leaves, and with them the sum of n * log2(n), in millionths
and whole numbers. The entropy of a window of w characters is log2(w) - sum / w; windows at or over
the limit of their class join to spans. A candidate is suppressed if the matches of one pattern of
the allow-list cover it wholly.

Null and empty texts have no spans. Repeated rows each get their own result, and an empty table
gives none. Spans of one start come in the order of the kinds; equal kinds cannot start together.
Columns of the input come along as named in ``keep``; a result column whose name is among them
raises an error, which ``prefix`` avoids. Whole texts are read, in time in proportion to their
length but for the running sums (blocks of 512).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import col

#: Patterns of the base kinds, the group whose length counts and the length it must have: fixed values.
#: A run that is too short holds no other match, so the last two ask for their length at once.
BASE = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)

#: The matches of one of these cover a harmless candidate: words, constants, numbers and dates, what
#: the base kind hex has already, and samples from manuals.
ALLOWED = (
    r"[A-Z]?[a-z]+[+/_-]*",
    r"[A-Z_-]+",
    r"[0-9+/_-]+",
    r"[0-9a-f]+",
    r".*(?i:example|placeholder|changeme).*",
    r".*(?:0123456789|abcdefghij|ABCDEFGHIJ).*",
)


@dataclass(frozen=True)
class CharacterClass:
    kind: str
    #: Each place holds the characters that count as one.
    alphabet: tuple[str, ...]
    window: int
    #: Bits a character from which a window is suspicious.
    limit: float

    @property
    def pattern(self) -> str:
        members = "".join(sorted("".join(self.alphabet).replace("-", ""))) + ("-" if "-" in self.alphabet else "")
        return f"[{members}]{{{self.window},}}"

    @property
    def most(self) -> int:
        """The largest sum of n * log2(n), in millionths, of a window at the limit."""
        return math.floor((math.log2(self.window) - self.limit) * self.window * 1e6)


CLASSES = (
    CharacterClass("hexadecimal", tuple("0123456789") + ("Aa", "Bb", "Cc", "Dd", "Ee", "Ff"), 24, 3.0),
    CharacterClass("base64", tuple("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-"), 20, 3.75),
)


def weight(n: int) -> int:
    """n * log2(n) in millionths."""
    return round(n * math.log2(n) * 1e6) if n > 1 else 0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def _running_sums(values: Column, block: int = 512) -> Column:
    """Running sums of an array of integers: inside blocks, then over the sums of the blocks."""

    def inside(part: Column) -> Column:
        zero = F.array().cast("array<int>")
        return F.aggregate(part, zero, lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))

    def join(parts: Column) -> Column:
        ends = inside(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.zip_with(parts, ends, lambda p, end: F.transform(p, lambda x: x + end - F.element_at(p, -1))))

    def cut(whole: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(whole), F.lit(block))
        return _let(F.transform(starts, lambda s: inside(F.slice(whole, s, block))), join)

    return _let(values, cut)


def _span_type(fields: str = "") -> str:
    return f"array<struct<start:int,rank:int,end:int{fields}>>"


def _find(text: Column, rank: int, pattern: str, group: int = 0) -> Column:
    """Matches of a pattern, leftmost and apart: start, rank, end (code points) and value of the group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(matches: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
        values = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return F.transform(
            F.arrays_zip(_running_sums(sizes).alias("end"), matches.alias("match"), values.alias("value")),
            lambda x: F.struct(
                (x["end"] - F.length(x["match"])).alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["value"].alias("value")
            ),
        )

    kind = _span_type(",value:string")
    return F.when(text.rlike(pattern), _let(found, place).cast(kind)).otherwise(F.array().cast(kind))


def _base(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans of one base kind; a match whose group is too short is found and then dropped."""
    found = F.filter(_find(text, rank, pattern, group), lambda x: F.length(x["value"]) >= least)
    return F.transform(found, lambda x: x.dropFields("value")).cast(_span_type())


def _hot_runs(value: Column, kind: CharacterClass) -> Column:
    """Unions of suspicious windows of one candidate, as (start, end) inside it."""
    size, window = len(kind.alphabet), kind.window
    place = F.lit(None).cast("int")
    letters = [(k, c) for k, same in enumerate(kind.alphabet) for c in same]
    names = F.create_map(*[F.lit(x) for k, c in letters for x in (c, k)])
    gain = F.array(*[F.lit(weight(n) - weight(n - 1)) for n in range(1, window + 1)])
    start = F.struct(
        F.array_repeat(F.lit(0), size).alias("counts"),
        F.lit(0).alias("at"),
        F.lit(0).cast("long").alias("mixed"),
        F.array().cast("array<struct<start:int,end:int>>").alias("runs"),
    )

    def step(acc: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]
        back = F.when(leaves.isNull(), F.lit(0)).otherwise(gain[acc["counts"][leaves] - 1])
        had = acc["counts"][enters] - F.when(enters.eqNullSafe(leaves), 1).otherwise(0)
        at, mixed = acc["at"] + 1, acc["mixed"] - back + gain[had]
        counts = F.transform(
            acc["counts"],
            lambda n, k: n + F.when(k == enters, 1).otherwise(0) - F.when(k.eqNullSafe(leaves), 1).otherwise(0),
        )
        hot = (at >= window) & (mixed <= kind.most)
        last = F.try_element_at(acc["runs"], F.lit(-1))
        new = F.struct((at - window).alias("start"), at.alias("end"))
        longer = F.struct(last["start"].alias("start"), at.alias("end"))
        touches = F.coalesce(last["end"] >= at - window, F.lit(False))
        runs = (
            F.when(~hot, acc["runs"])
            .when(touches, F.array_append(F.slice(acc["runs"], 1, F.size(acc["runs"]) - 1), longer))
            .otherwise(F.array_append(acc["runs"], new))
        )
        return F.struct(counts.alias("counts"), at.cast("int").alias("at"), mixed.cast("long").alias("mixed"), runs.alias("runs"))

    def slide(codes: Column) -> Column:
        gone = F.concat(F.array_repeat(place, window), F.slice(codes, 1, F.greatest(F.size(codes) - window, F.lit(0))))
        return F.aggregate(F.arrays_zip(codes.alias("enters"), gone.alias("leaves")), start, step, lambda acc: acc["runs"])

    return _let(F.transform(F.split(value, ""), lambda c: names[c]), slide)


def _suspicious(text: Column, rank: int, kind: CharacterClass, allowed: tuple[str, ...]) -> Column:
    """Spans of suspicious windows in the candidates of one class."""

    def harmless(value: Column) -> Column:
        covered = [F.length(F.regexp_replace(value, p, "")) == 0 for p in allowed]
        return F.exists(F.array(F.lit(False), *covered), lambda x: x)

    candidates = F.filter(_find(text, rank, kind.pattern), lambda c: ~harmless(c["value"]))
    spans = F.transform(
        candidates,
        lambda c: F.transform(
            _hot_runs(c["value"], kind),
            lambda r: F.struct(
                (c["start"] + r["start"]).alias("start"), F.lit(rank).alias("rank"), (c["start"] + r["end"]).alias("end")
            ),
        ),
    )
    return F.flatten(spans).cast(_span_type())


def _as_text(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ",")


def scan_secrets(
    docs: DataFrame,
    classes: tuple[CharacterClass, ...] = CLASSES,
    allowed: tuple[str, ...] = ALLOWED,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    prefix: str = "",
) -> DataFrame:
    """The columns ``keep`` of every row (default: all) and, named with ``prefix``: n_assign,
    n_access, n_hex (matches of each base kind), base_sha256 (of those as kind:start:end), spans
    (all of them as such text), and secrets, the same as an array of kind, start and end."""
    keep = docs.columns if keep is None else keep
    kinds = [k for k, *_ in BASE] + [c.kind for c in classes]
    added = [prefix + n for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "secrets")]
    clash = {c.lower() for c in keep} & {c.lower() for c in added}
    if clash:
        raise ValueError(f"columns named {sorted(clash)} are in the table already; give a prefix")
    whole = F.coalesce(col(text), F.lit(""))
    names = [f"__found_{k}" for k in range(len(kinds))]
    columns = [_base(whole, rank, *rest) for rank, (_, *rest) in enumerate(BASE)]
    for rank, kind in enumerate(classes, len(BASE)):
        columns.append(_suspicious(whole, rank, kind, allowed))
    found = docs.select(*[col(c).alias(f"__kept_{k}") for k, c in enumerate(keep)], *[c.alias(n) for c, n in zip(columns, names)])
    base = F.array_sort(F.concat(*names[: len(BASE)]))
    every = F.array_sort(F.concat(*names))
    named = F.array(*[F.lit(k) for k in kinds])
    results = [
        *[F.size(n).cast("long") for n in names[: len(BASE)]],
        F.sha2(_as_text(base, kinds).cast("binary"), 256),
        _as_text(every, kinds),
        F.transform(every, lambda s: F.struct(named[s["rank"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))),
    ]
    return found.select(
        *[F.col(f"__kept_{k}").alias(c) for k, c in enumerate(keep)], *[r.alias(n) for r, n in zip(results, added)]
    )
