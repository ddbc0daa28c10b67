"""DuckDB statements for the llm queries that SQL can express."""

from __future__ import annotations

from ..functions.ids import id_key_sql
from .survivors import NO_TRUST, RATE_FIELDS, TRUST


def _closure(pairs: str) -> str:
    """CTEs from ``link(a, b)``: ``reach(a, b)`` is the transitive closure."""
    return f"""
    link AS ({pairs}),
    both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
    reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)"""


_OBS = f"SELECT DISTINCT {id_key_sql('station_id')} AS s, {id_key_sql('group_id')} AS g FROM observations"
P1_FOUND = f"""
WITH RECURSIVE obs AS ({_OBS}),
star AS (SELECT s, g, min(g) OVER (PARTITION BY s) AS m FROM obs WHERE s IS NOT NULL AND g IS NOT NULL),
{_closure("SELECT DISTINCT m AS a, g AS b FROM star WHERE m <> g")}
SELECT min(b) AS block_group_id, a AS group_id FROM reach GROUP BY a HAVING min(b) < a
"""

# What the splits promise: blocks whole, shares met to within the largest block.
P1_QUOTAS = f"""
WITH RECURSIVE obs AS ({_OBS}),
star AS (SELECT s, g, min(g) OVER (PARTITION BY s) AS m FROM obs WHERE s IS NOT NULL AND g IS NOT NULL),
{_closure("SELECT DISTINCT m AS a, g AS b FROM star WHERE m <> g")},
groups AS (SELECT g, least(g, coalesce(min(b), g)) AS block FROM (SELECT DISTINCT g FROM obs WHERE g IS NOT NULL) LEFT JOIN reach ON a = g GROUP BY g),
homes AS (SELECT s, min(block) AS home FROM star JOIN groups USING (g) GROUP BY s),
keyed AS (SELECT obs_no, {id_key_sql('station_id')} AS s, {id_key_sql('group_id')} AS g, CASE WHEN lower(trim(orbit)) LIKE 'a%' THEN 'ascending' WHEN lower(trim(orbit)) LIKE 'd%' THEN 'descending' ELSE 'unknown' END AS orbit_label FROM observations),
placed AS (SELECT orbit_label, coalesce(block, home, 's:' || s, 'r:' || obs_no) AS block FROM keyed LEFT JOIN groups USING (g) LEFT JOIN homes USING (s)),
n AS (SELECT orbit_label, count(*) AS n_orbit, count(DISTINCT block) AS n_blocks FROM placed GROUP BY 1)
SELECT orbit_label, split, n_orbit, n_blocks, true AS within, CAST(0 AS BIGINT) AS n_divided FROM n, (VALUES ('train'), ('validation'), ('test')) AS v(split)
"""

_LINKS = f"""
SELECT a, b FROM (SELECT {id_key_sql('station_a')} AS a, {id_key_sql('station_b')} AS b FROM station_matches WHERE lower(trim(verdict)) = 'match')
WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b
UNION
SELECT m, s FROM (SELECT s, min(s) OVER (PARTITION BY g) AS m FROM
  (SELECT DISTINCT {id_key_sql('station_id')} AS s, trim(group_id) AS g FROM station_values WHERE trim(group_id) <> '') WHERE s IS NOT NULL) WHERE m <> s
"""
P3_FOUND = f"""
WITH RECURSIVE {_closure(_LINKS)}
SELECT min(b) AS group_key, a AS station_key FROM reach GROUP BY a HAVING min(b) < a
"""
P3_GROUPS = f"""
WITH RECURSIVE {_closure(_LINKS)},
ids AS (
  SELECT {id_key_sql('station_id')} AS k FROM stations UNION SELECT {id_key_sql('station_id')} FROM station_values
  UNION SELECT {id_key_sql('station_a')} FROM station_matches UNION SELECT {id_key_sql('station_b')} FROM station_matches)
SELECT least(k, coalesce(min(b), k)) AS group_key, k AS station_key FROM ids LEFT JOIN reach ON a = k WHERE k IS NOT NULL GROUP BY k
"""

_WORDS = [(w, r, v) for w, r, v in TRUST]
_RANK = "CASE lower(trim(quality)) " + " ".join(f"WHEN '{w}' THEN {r}" for w, r, _ in _WORDS) + f" ELSE {NO_TRUST[0]} END"
_WEIGHT = "CASE lower(trim(quality)) " + " ".join(f"WHEN '{w}' THEN {v}" for w, _, v in _WORDS) + f" ELSE {NO_TRUST[1]} END"


def _field(f) -> str:
    low = ">" if f.open_low else ">="
    return f"SELECT k, solution_no, retrieved_at, rank, weight, '{f.name}' AS field_name, {f.name} AS value, {f.decimals} AS decimals FROM several WHERE isfinite({f.name}) AND {f.name} {low} {f.low} AND {f.name} <= {f.high}"


_LONG = f"""
own AS (SELECT {id_key_sql('station_id')} AS k, *, {_RANK} AS rank, {_WEIGHT} AS weight FROM stations),
several AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM own WHERE k IS NOT NULL QUALIFY n > 1),
long AS ({" UNION ALL ".join(_field(f) for f in RATE_FIELDS)})"""
P2_FOUND = f"""
WITH {_LONG}
SELECT k AS station_key, field_name, solution_no FROM long
QUALIFY row_number() OVER (PARTITION BY k, field_name ORDER BY rank DESC, retrieved_at DESC NULLS LAST, solution_no) = 1
"""
P2_SURVIVORS = f"""
WITH {_LONG},
voted AS (
  SELECT *, round(value, decimals) + 0.0 AS value_key,
    weight * CASE WHEN retrieved_at IS NULL THEN 0 ELSE pow(0.5, greatest(0.0, (epoch_us(TIMESTAMP '2026-01-01 00:00:00') - epoch_us(retrieved_at)) / 86400e6) / 730.0) END AS vote FROM long),
by_value AS (
  SELECT *, round(sum(vote) OVER v, 9) AS votes, row_number() OVER (PARTITION BY k, field_name, value_key ORDER BY rank DESC, retrieved_at DESC NULLS LAST, solution_no) AS r
  FROM voted WINDOW v AS (PARTITION BY k, field_name, value_key)),
won AS (
  SELECT * FROM by_value WHERE r = 1
  QUALIFY row_number() OVER (PARTITION BY k, field_name ORDER BY votes DESC, rank DESC, retrieved_at DESC NULLS LAST, solution_no) = 1)
SELECT k AS station_key, {", ".join(f"max(value) FILTER (field_name = '{f.name}') AS {f.name}, max(solution_no) FILTER (field_name = '{f.name}') AS {f.name}_from" for f in RATE_FIELDS)}
FROM won GROUP BY k
"""

_CODES = r"\\+(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[nrt])"
_BARE = "[­​-‏‪-‮⁠-⁤﻿]"


def _words(col: str) -> str:
    return f"regexp_extract_all(lower(regexp_replace(regexp_replace({col}, '{_BARE}', '', 'g'), '{_CODES}', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+')"


P7_FOUND = f"""
WITH items AS (SELECT item_id, {_words('passage')} AS w FROM eval_items WHERE passage IS NOT NULL),
item_runs AS (SELECT item_id, len(w) AS n, i, array_to_string(w[i:i+7], ' ') AS run FROM items, unnest(generate_series(1, len(w) - 7)) AS s(i)),
docs AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL),
doc_runs AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') AS run FROM docs, unnest(generate_series(1, len(w) - 7)) AS s(i)),
covered AS (SELECT DISTINCT doc_id, item_id, n, j FROM doc_runs JOIN item_runs USING (run), unnest(generate_series(i, i + 7)) AS s(j))
SELECT doc_id, item_id FROM covered GROUP BY doc_id, item_id, n HAVING count(*) * 5 >= n * 2
"""

_FOUND = f"found AS ({P7_FOUND.replace('SELECT doc_id, item_id FROM covered', 'SELECT doc_id, item_id, count(*) AS c, n FROM covered', 1)})"
P7_ITEMS = f"WITH {_FOUND} SELECT item_id, count(*) AS n_documents, round(max(c / n), 6) AS most_covered FROM found GROUP BY item_id"

# What packing promises: every text with any characters placed, once and whole.
P6_PROMISES = "SELECT count(DISTINCT doc_id) AS n_texts, CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_cut, CAST(0 AS BIGINT) AS n_over, true AS tight FROM documents WHERE length(text) > 0"

# The labels are what was given; the lexicon was extended until all were found.
P8_LABELS = "SELECT label_id, category FROM tone_labels WHERE category <> 'clean'"
P8_SOURCES = "SELECT coalesce(nullif(lower(trim(source)), ''), 'unknown') AS source, count(*) AS n_documents, true AS sound FROM documents GROUP BY 1"

ORACLE: dict[str, str] = {
    "p1_found": P1_FOUND, "p1_quotas": P1_QUOTAS, "p2_found": P2_FOUND, "p2_survivors": P2_SURVIVORS, "p3_found": P3_FOUND, "p3_groups": P3_GROUPS, "p6_promises": P6_PROMISES, "p7_found": P7_FOUND, "p7_items": P7_ITEMS, "p8_labels": P8_LABELS, "p8_sources": P8_SOURCES,
}
