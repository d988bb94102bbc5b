"""Pieces of the SQL that the queries are checked against, in DuckDB's dialect."""

from __future__ import annotations

from cratewave.functions import harmony as H

VECTORS = """v AS (SELECT ord, vec_id, embedding::DOUBLE[] AS v FROM (
  SELECT *, row_number() OVER (PARTITION BY ord ORDER BY built_at DESC NULLS LAST, vec_id DESC) AS rn FROM track_vectors
  WHERE ord IS NOT NULL AND len(embedding) = 128 AND len(list_filter(embedding, lambda x: isfinite(x))) = 128
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0) WHERE rn = 1)"""
INDEX = VECTORS + """, idx AS (SELECT row_number() OVER (ORDER BY t.ord) - 1 AS label, t.*, v.v FROM v JOIN tracks t ON t.ord = v.ord)"""


def tags(c: str) -> str:
    return f"list_filter(list_transform(coalesce({c}, []::VARCHAR[]), lambda t: trim(t)), lambda t: t IS NOT NULL AND t <> '')"


def exploded(c: str = "mytags", table: str = "tracks") -> str:
    """(ord, pos, tag)"""
    return f"SELECT ord, unnest(range(len(l))) AS pos, unnest(l) AS tag FROM (SELECT ord, {tags(c)} AS l FROM {table})"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def dist(a: str, b: str) -> str:
    return f"(1 - {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


_KEY = r"'^([+-]?\d+)\s*([AB])$'"


def number(k: str) -> str:
    return f"(CASE WHEN regexp_matches(upper(trim({k})), {_KEY}) THEN ((TRY_CAST(regexp_extract(upper(trim({k})), {_KEY}, 1) AS INTEGER) - 1) % 12 + 12) % 12 + 1 END)"


def letter(k: str) -> str:
    return f"(CASE WHEN regexp_matches(upper(trim({k})), {_KEY}) THEN regexp_extract(upper(trim({k})), {_KEY}, 2) END)"


def relation(s: str, c: str) -> str:
    step = f"((({number(c)} - {number(s)}) % 12 + 12) % 12)"
    a, b = letter(s), letter(c)
    return f"""(CASE WHEN {number(s)} IS NULL OR {number(c)} IS NULL THEN '-' WHEN {a} = {b} AND {step} = 0 THEN '{H.SAME}' WHEN {a} = {b} AND {step} IN (1, 11) THEN '{H.NEXT}'
      WHEN {a} <> {b} AND {step} = 0 THEN '{H.RELATIVE}' WHEN {a} = {b} AND {step} = 7 THEN '{H.RAISE}' WHEN {a} = {b} AND {step} = 2 THEN '{H.BOOST}'
      WHEN {a} = 'A' AND {b} = 'B' AND {step} = 3 THEN '{H.TO_MAJOR}' WHEN {a} = 'B' AND {b} = 'A' AND {step} = 9 THEN '{H.TO_MINOR}' ELSE '-' END)"""


def compatible(s: str, c: str) -> str:
    return f"({number(s)} IS NULL OR {number(c)} IS NULL OR {relation(s, c)} <> '-')"


def relation_score(s: str, c: str) -> str:
    plain = lambda k: rf"TRY_CAST(NULLIF(regexp_extract(upper(trim({k})), '^(\d+)[AB]$', 1), '') AS INTEGER)"
    step = f"((({plain(c)} - {plain(s)}) % 12 + 12) % 12)"
    return f"(CASE WHEN {s} IS NULL OR {c} IS NULL OR trim({s}) = '' OR trim({c}) = '' THEN 0.0 WHEN upper(trim({s})) = upper(trim({c})) THEN 1.0 WHEN {step} = 0 THEN 0.8 WHEN {step} IN (1, 11) THEN 0.7 ELSE 0.0 END)"


def tempo(s: str, c: str, pct: float = 6.0) -> str:
    f = pct / 100.0
    return f"(coalesce({s}, 0) = 0 OR coalesce({c}, 0) = 0 OR abs({s} - {c}) <= {s} * {f} OR abs({s} * 2 - {c}) <= ({s} * 2) * {f} OR abs({s} / 2 - {c}) <= ({s} / 2) * {f})"


def tempo_score(s: str, c: str, most: float) -> str:
    return f"(CASE WHEN {s} > 0 AND {c} > 0 AND abs({s} - {c}) <= {most} THEN greatest(0.0, 1 - abs({s} - {c}) / {most}) ELSE 0.0 END)"


def contour(a: str, b: str, length: int, log: bool) -> str:
    """exp(-distance / 2) of two contours of the same length; padding adds nothing to the distance."""
    form = lambda x: f"list_transform({x}, lambda y: ln(greatest(y, 1.0)))" if log else x
    return f"exp(-list_distance({form(a)}, {form(b)}) / 2)"


BASS = "list_transform(v[1:64], lambda x: 40 + 160 * abs(x))"
RHYTHM = "list_transform(v[65:128], lambda x: 40 + 160 * abs(x))"
EPOCH_BEATS = "beats AS (SELECT user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) / 1000000.0 AS t FROM events WHERE user_id IS NOT NULL)"
