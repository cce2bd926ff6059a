"""Expressions of the comparison SQL that several queries share."""

from __future__ import annotations

from rollkeep.functions.fuzzy import grams, lost_grams
from rollkeep.functions.text import TITLES


def number_key(x: str) -> str:
    return f"substr(regexp_replace(lower(coalesce({x}, '')), '[^0-9a-z]+', '', 'g'), 1, 200)"


def words(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')"


def name_key(x: str) -> str:
    titles = ", ".join(f"'{t}'" for t in TITLES)
    w = words(x)
    return f"coalesce(array_to_string({w}[list_position(list_transform({w}, lambda w: w IN ({titles})), false):], ' '), '')"


def trigrams(x: str) -> str:
    w = f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({w}, lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def similarity(a: str, b: str) -> str:
    x, y = trigrams(a), trigrams(b)
    return f"(len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))))"


def likeness(lines: str, names: list[str], least: float) -> str:
    """CTEs on ``lines`` (a relation with column low): ``lk`` (low, name, pos, length, ratio), the first best window of a line for each name.

    The characters two texts share in order are counted by the bits of the shorter one that are left
    over, folded over the window; lines with too few of a name's neighbouring pairs are left out first.
    """
    pairs = "list_distinct(list_transform(range(1, CAST(length({0}) AS BIGINT)), lambda i: substr({0}, i, 2)))"
    held = ", ".join("('" + n.replace("'", "''") + f"', {len(n)}, {len(grams(n)) - lost_grams(len(n), least)})" for n in sorted(set(names)))
    lost = [lost_grams(n, least) for n in range(1, max(map(len, names)) + 1)]
    return f"""lk_n AS (SELECT * FROM (VALUES {held}) t(name, n, need)),
lk_l AS (SELECT low, length(low) AS k, {pairs.format("low")} AS g FROM (SELECT DISTINCT low FROM {lines}) WHERE low <> ''),
lk_c AS (SELECT low, name, n <= k AS direct, CASE WHEN n <= k THEN name ELSE low END AS s, CASE WHEN n <= k THEN low ELSE name END AS l, least(n, k) AS n, greatest(n, k) AS k FROM lk_l, lk_n
 WHERE CASE WHEN n <= k THEN len(list_intersect(g, {pairs.format("name")})) >= need WHEN k <= 3 THEN contains(name, low) ELSE len(list_intersect(g, {pairs.format("name")})) >= len(g) - {lost}[k] END),
lk_m AS (SELECT *, (1::BIGINT << n) - 1 AS every, list_transform(string_split(l, ''), lambda c: CAST(list_sum(list_transform(range(CAST(n AS BIGINT)), lambda i: CASE WHEN substr(s, i + 1, 1) = c THEN 1::BIGINT << i ELSE 0 END)) AS BIGINT)) AS m FROM lk_c),
lk_w AS (SELECT * EXCLUDE w, w.i AS i, w.j AS j, w.o AS o FROM (SELECT *, unnest(list_concat(list_transform(range(1, CAST(n AS BIGINT)), lambda e: {{'i': 0::BIGINT, 'j': e, 'o': e}}),
 list_transform(range(CAST(k - n AS BIGINT)), lambda i: {{'i': i, 'j': i + n, 'o': n + i}}), list_transform(range(CAST(k - n AS BIGINT), CAST(k AS BIGINT)), lambda i: {{'i': i, 'j': k, 'o': n + i}}))) AS w FROM lk_m)),
lk_r AS (SELECT *, 200.0::DOUBLE * (n - bit_count(list_reduce(list_prepend(every, m[i + 1:j]), lambda x, y: ((x + (x & y)) | (x - (x & y))) & every))) / (n + j - i) / 100 AS ratio FROM lk_w),
lk_b AS (SELECT *, row_number() OVER (PARTITION BY low, name ORDER BY ratio DESC, o) AS place FROM lk_r WHERE ratio * 100 >= {least} - 1e-9),
lk AS (SELECT low, name, CASE WHEN direct THEN i + 1 ELSE 1 END AS pos, CASE WHEN direct THEN j - i ELSE length(low) END AS length, ratio FROM lk_b WHERE place = 1)"""
