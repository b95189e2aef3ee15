"""The registered queries once more, as plain SQL over the given tables (for DuckDB).

Written relationally — flat rows, joins, ordered string aggregation — where the Spark side works on
nested rows, so that the two share no approach.
"""

from __future__ import annotations

from spanloom.ontology import starter_ontology
from spanloom.plans.derived import LANG_DATASET, LINES, OTHER_DATASET

ONTO = starter_ontology()
WS = r"[\s\x1C-\x1F\x{85}\p{Z}]"
W = r"[\p{L}\p{N}_]"


def lit(s) -> str:
    return "NULL" if s is None else str(s) if isinstance(s, int) else "'" + s.replace("'", "''") + "'"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows) + ")"


def rr(x: str, pat: str, to: str) -> str:
    return f"regexp_replace({x}, {lit(pat)}, {lit(to)}, 'g')"


def strip(x: str) -> str:
    return rr(x, f"^{WS}+|{WS}+$", "")


def ws(x: str) -> str:
    return f"trim({rr(x, WS + '+', ' ')})"


def clean(x: str) -> str:
    x = rr(x, rf"{WS}+([,.?!;:%])", r"\1")
    x = rr(x, rf"\({WS}+", "(")
    x = rr(x, rf"{WS}+\)", ")")
    x = rr(x, rf'{WS}+"', '"')
    x = rr(x, rf'"{WS}+', '"')
    return ws(x)


def spaced(x: str) -> str:
    return ws(rr(x, r"([^\p{L}\p{N}_\s\x1C-\x1F\x{85}\p{Z}])", r" \1 "))


_first4 = [(ds, k, t) for ds in LANG_DATASET.values() for k, t in enumerate(list(ONTO.roles[ds])[:4])]
_roles4 = [(t, k, r) for ds, _, t in _first4 for k, r in enumerate(ONTO.roles[ds][t][:4])]

# Common tables, each naming those it needs; a query lists the ones it reads.
CTE: dict[str, tuple[str, tuple[str, ...]]] = {
    "types4": (f"types4(dataset, k, etype) AS {values(_first4)}", ()),
    "roles4": (f"roles4(etype, k, role) AS {values(_roles4)}", ()),
    "dim_types": (f"dim_types(dataset, event_type, type_ord) AS {values(ONTO.type_rows())}", ()),
    "dim_roles": (f"dim_roles(dataset, event_type, type_ord, role, role_ord) AS {values(ONTO.role_rows())}", ()),
    "dim_tags": (f"dim_tags(dataset, ds_ord, event_type, tag) AS {values(ONTO.tag_rows())}", ()),
    "dim_map": (f"dim_map(dataset, original_type, unified_type) AS {values(ONTO.type_map_rows())}", ()),
    "dim_role_map": (f"dim_role_map(dataset, original_type, original_role, unified_role, ord) AS {values(ONTO.role_map_rows())}", ()),
    "dim_unified": (f"dim_unified(unified_type, type_group, secondary_type, description) AS {values(ONTO.unified_rows())}", ()),
    "lines": ("""lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)""", ()),
    "sent": (f"""sent AS MATERIALIZED (SELECT *, 'doc_' || sid AS doc_id, len(tokens) AS n, {clean("array_to_string(tokens, ' ')")} AS plain FROM (
        SELECT doc_id AS src_id, doc_id * {LINES} + line_no AS sid, doc_id * 1000 + line_no AS m,
          CASE lang {' '.join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in LANG_DATASET.items())} ELSE {lit(OTHER_DATASET)} END AS dataset,
          CASE doc_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split,
          string_split({spaced('line')}, ' ') AS tokens FROM lines)
        WHERE len(tokens) > 1 OR tokens[1] <> '')""", ("lines",)),
    "hit": ("""hit AS MATERIALIZED (SELECT * FROM (SELECT sid, src_id, doc_id, split, m, n, dataset, unnest(tokens) AS t, generate_subscripts(tokens, 1) - 1 AS i FROM sent)
        WHERE length(t) >= 6 AND (m + i) % 17 = 0)""", ("sent",)),
    "ev": (f"""ev AS MATERIALIZED (SELECT x.*, least(raw_e, n) AS e, raw_e > s AS valid, {clean("array_to_string(tokens[s + 1:least(raw_e, n)], ' ')")} AS txt FROM (
        SELECT h.sid, h.src_id, h.doc_id, h.split, h.m, h.n, h.dataset, h.i, sh.shift, row_number() OVER (PARTITION BY h.sid ORDER BY i, shift) - 1 AS pos, t.etype,
          CASE WHEN i % 2 = 0 THEN (CASE WHEN shift = 0 THEN 'e' ELSE 'd' END) || i END AS id, i AS s,
          CASE WHEN (m + i) % 97 = 0 THEN i WHEN (m + i) % 53 = 0 THEN n + 3 ELSE i + 1 + CASE WHEN (m + i) % 5 = 0 THEN 1 ELSE 0 END END AS raw_e
        FROM hit h JOIN (VALUES (0), (1)) sh(shift) ON shift = 0 OR (m + i) % 19 = 0
        JOIN types4 t ON t.dataset = h.dataset AND t.k = ((m + i) % 4 + shift) % 4) x JOIN (SELECT sid, tokens FROM sent) USING (sid))""", ("hit", "types4")),
    "arg": (f"""arg AS MATERIALIZED (SELECT sid, pos, m, k, dataset, doc_id, split, etype, st, en, role, base_role, alt, style, {clean("array_to_string(tokens[st + 1:en], ' ')")} AS txt FROM (
        SELECT ev.sid, ev.pos, ev.m, ev.dataset, ev.doc_id, ev.split, ev.etype, r.k, i + 2 + 2 * r.k AS st, i + 3 + 2 * r.k + r.k % 2 AS en, (m + r.k) % 4 AS style, r.role AS base_role,
          CASE WHEN (m + r.k) % 7 = 0 THEN upper(r.role) ELSE r.role END AS role, (m + r.k) % 11 = 0 AS alt
        FROM ev JOIN roles4 r ON r.etype = ev.etype WHERE (m + i + r.k) % 2 = 0 AND i + 3 + 2 * r.k + r.k % 2 <= n) JOIN (SELECT sid, tokens FROM sent) USING (sid))""", ("ev", "roles4")),
    "sp": ("""sp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY s, e, pos) - 1 AS j,
        row_number() OVER (PARTITION BY sid, s, e ORDER BY pos) AS dup, first_value(etype) OVER (PARTITION BY sid, s, e ORDER BY pos) AS ptype,
        lag(e, 1, 0) OVER (PARTITION BY sid ORDER BY s, e, pos) AS prev_e FROM ev WHERE valid)""", ("ev",)),
    "us": ("""us AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY s, e) - 1 AS p,
        lag(e, 1, 0) OVER (PARTITION BY sid ORDER BY s, e) AS uprev FROM sp WHERE dup = 1)""", ("sp",)),
    "evargs": ("""evargs AS (SELECT sid, pos, string_agg('argument>' || txt || '>=' || role, ' | ' ORDER BY k) AS a1,
        string_agg('argument>' || txt || '>=' || role, ' ## ' ORDER BY k) AS a2,
        string_agg('argument>' || txt || '>=' || role || '(' || etype || ')', ' | ' ORDER BY k) AS a3,
        string_agg('argument> ' || txt || '>=' || role, ' | ' ORDER BY k) AS a4 FROM arg WHERE txt <> '' GROUP BY ALL)""", ("arg",)),
    "nargs": ("nargs AS (SELECT sid, pos, count(*) AS n_args FROM arg GROUP BY ALL)", ("arg",)),
    "aeok": ("""aeok AS (SELECT ev.* FROM ev JOIN nargs USING (sid, pos) WHERE valid)""", ("ev", "nargs")),
}


def sql(body: str, *names: str, extra: str = "", recursive: bool = False) -> str:
    """``body`` with the common tables it names in front, dependencies first."""
    seen: list[str] = []

    def need(n: str) -> None:
        for d in CTE[n][1]:
            need(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        need(n)
    parts = [CTE[n][0] for n in seen] + ([extra] if extra else [])
    return ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n" if parts else "") + body


ORACLE: dict[str, str] = {}
