"""Queries of scenes made up from the keys of given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scenes as S
from .registry import query, table

_U = "('0x' || substr(md5('{s}:{what}:' || {key}), 1, 13))::BIGINT / 4503599627370496.0"


def _draw(what: str, key: str = "p_partkey", s: int = 0) -> str:
    return _U.format(s=s, what=what, key=key)


_OBJECTS = f"""(SELECT p_partkey, k, floor({_draw("' || k || '-kind")} * 3)::INT AS kind, r, r * sqrt(2) + {_draw("' || k || '-x")} * (31 - 2 * r * sqrt(2)) AS cx, r * sqrt(2) + {_draw("' || k || '-y")} * (31 - 2 * r * sqrt(2)) AS cy, {_draw("' || k || '-angle")} * 2 * pi() AS a
FROM (SELECT p_partkey, k, 3 + {_draw("' || k || '-r")} * 4 AS r FROM (SELECT p_partkey, unnest(range(0, floor({_draw("count")} * 3)::INT + 1)) AS k FROM part)))"""
_REACH = "r * (abs(cos(a)) + abs(sin(a)))"
_THIRD = "2 * pi() / 3"


def _edge(f: str, pick: str, sign: str) -> str:
    return f"CASE kind WHEN 0 THEN {sign}r WHEN 1 THEN {sign}{_REACH} ELSE {pick}(r * {f}(a), r * {f}(a + {_THIRD}), r * {f}(a + 2 * {_THIRD})) END"


def _scenes(spark, sf):
    return S.scenes(table(spark, sf, "part").select("p_partkey"), "p_partkey")


@query(f"""SELECT p_partkey, k, kind, round(cx + {_edge('cos', 'least', '-')}, 6) AS x1, round(cy + {_edge('sin', 'least', '-')}, 6) AS y1, round(cx + {_edge('cos', 'greatest', '')}, 6) AS x2, round(cy + {_edge('sin', 'greatest', '')}, 6) AS y2 FROM {_OBJECTS}""")
def scene_boxes(spark, sf):
    """Kinds and boxes of the objects of a scene for every part."""
    o = _scenes(spark, sf).select("p_partkey", F.posexplode("objects").alias("k", "o")).select("p_partkey", F.col("k").cast("long").alias("k"), F.col("o.kind").alias("kind"), S.box_of(F.col("o")).alias("b"))
    return o.select("p_partkey", "k", "kind", *[F.round(f"b.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


_W = "(31 - 2 * r * sqrt(2))"


def _bounce(c: str) -> str:
    v = _draw(f"' || k || '-v{c}", s=5)
    turn = f"(c{c} - r * sqrt(2) + ({v} * 2 - 1) * 2 * t)"
    return f"r * sqrt(2) + {_W} - abs({turn} - floor({turn} / (2 * {_W})) * 2 * {_W} - {_W})"


@query(f"SELECT p_partkey, t::INT AS t, k::INT AS track, round({_bounce('x')}, 6) AS cx, round({_bounce('y')}, 6) AS cy FROM {_OBJECTS}, range(8) AS s(t)")
def scene_tracks(spark, sf):
    """Where the objects of every scene are at eight steps."""
    found = S.tracks(_scenes(spark, sf), "p_partkey", 8, seed=5)
    return found.select("p_partkey", "t", "track", F.round("o.cx", 6).alias("cx"), F.round("o.cy", 6).alias("cy"))


@query()
def scene_pictures(spark, sf):
    """How bright the picture of every part's scene is, how many pixels its mask has of each kind, what it shows, and the least visible share."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    base = _scenes(spark, sf)
    bright = S.painted(base).select("p_partkey", total(F.col("pixels")).alias("brightness"), S.caption(F.col("objects")).alias("caption"))
    mask = S.masks(base).select("p_partkey", F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.size(F.filter("pixels", lambda x: x == k))).alias("sizes"))
    seen = S.visible_shares(base).select("p_partkey", F.round(F.array_min("visible"), 9).alias("least_visible"))
    return bright.join(mask, "p_partkey").join(seen, "p_partkey")


@query(f"""WITH e AS (SELECT c_custkey, floor({_draw("' || k || '-f", "c_custkey", 2)} * 200)::INT AS feature, {_draw("' || k || '-v", "c_custkey", 2)} * 2 - 1 AS value FROM customer, range(1, 9) AS r(k)),
l AS (SELECT c_custkey, feature, sum(value) AS value FROM e GROUP BY ALL)
SELECT c_custkey, round(sum(value * CASE WHEN feature < 50 THEN {_draw('weight', 'feature', 2)} * 2 - 1 ELSE 0 END) + 0.1 * ({_draw('noise', 'c_custkey', 2)} * 2 - 1), 6) + 0 AS y, count(*) AS n FROM l GROUP BY c_custkey""")
def sparse_rows(spark, sf):
    """A sparse row for every customer: its target and how many features it has."""
    long, target = S.sparse_rows(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 200, 8, seed=2)
    return target.join(long.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n")), "c_custkey").select("c_custkey", (F.round("y", 6) + 0.0).alias("y"), "n")
