"""Scalar column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.schema import ENTROPY_EPSILON, MANIFOLDS, MAX_EDGE, PORT_FLAGS


def last_octet(address: Column) -> Column:
    """``192.168.0.17`` -> 17."""
    return F.element_at(F.split(address, "[.]"), -1).cast("int")


def port_flag(port: Column) -> Column:
    """Known ports to 0/1, every other port to NULL."""
    known = [F.when(port == p, F.lit(flag)) for p, flag in PORT_FLAGS.items()]
    return F.coalesce(*known)


def ratio(num: Column, den: Column) -> Column:
    """num/den, or 0 where den is 0 or missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def is_class(label: Column, name: str) -> Column:
    return (label == name).cast("int")


def flag_pattern(flags: list[Column]) -> Column:
    """Boolean flags -> '101'."""
    return F.concat(*[f.cast("int").cast("string") for f in flags])


def any_flag(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def strip_suffix(name: Column, tag: str) -> Column:
    """``SVM (Tag)`` -> ``SVM``."""
    return F.regexp_replace(name, rf" \({tag}\)", "")


def provenance(feature: Column) -> Column:
    """Topology features carry a manifold prefix, all others are original."""
    topo = any_flag([feature.contains(f"{m}_") for m in MANIFOLDS])
    return F.when(topo, "topology").otherwise("original")


def manifold_of(feature: Column) -> Column:
    named = [F.when(feature.contains(f"{m}_"), F.lit(m)) for m in MANIFOLDS]
    return F.coalesce(*named, F.lit("Original"))


def dimension_of(feature: Column) -> Column:
    """H0/H1/H2 of a topology feature name, '-' otherwise."""
    found = F.regexp_extract(feature, "_(H[0-2])_", 1)
    return F.when(found == "", F.lit("-")).otherwise(found)


def cap_death(death: Column, cap: float = MAX_EDGE) -> Column:
    """Essential bars end at the largest edge length."""
    return F.when(death == float("inf"), F.lit(cap)).otherwise(death)


def merged_bars(bars: Column, cap: float = MAX_EDGE) -> Column:
    """Bars of all dimensions as (birth, death) with capped deaths."""
    return F.transform(
        bars,
        lambda b: F.struct(b["birth"].alias("birth"), cap_death(b["death"], cap).alias("death")),
    )


def bars_of_dim(bars: Column, dim: int) -> Column:
    return F.filter(bars, lambda b: b["dim"] == dim)


def entropy_term(persistence: Column, total: Column) -> Column:
    p = F.try_divide(persistence, total)
    return -p * F.ln(p + F.lit(ENTROPY_EPSILON))


def vector(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def hash_order(key: Column, seed: int) -> Column:
    """A reproducible shuffle order: the md5 text of 'seed:key'."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
