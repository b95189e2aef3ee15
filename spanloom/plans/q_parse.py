"""Registered queries over derived model outputs: parsing, structuring, review."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import offsets as O
from spanloom.functions import prompts as P
from spanloom.functions import text as T
from spanloom.ontology import starter_ontology
from spanloom.operators import parse as X
from spanloom.operators import review
from spanloom.plans.derived import LINES, corpus, dealt, outputs, runs, shared, table
from spanloom.plans.oracle import CTE, W, WS, clean, spaced, sql, strip, ws
from spanloom.plans.registry import query

ONTO = starter_ontology()
NW = r"[^\p{L}\p{N}_]"

# ---- common tables of the SQL side ---------------------------------------------------------------
CTE["pe"] = ("""pe AS MATERIALIZED (SELECT *, CASE WHEN q % 13 = 0 AND cnt > 1 AND o0 < 2 THEN 1 - o0 ELSE o0 END AS o FROM (
    SELECT us.sid, us.doc_id, us.dataset, us.pos, p, mode, q, txt, CASE WHEN (q + p) % 7 = 0 THEN t2.etype ELSE us.etype END AS ty,
      row_number() OVER (PARTITION BY us.sid, mode ORDER BY p) - 1 AS o0, count(*) OVER (PARTITION BY us.sid, mode) AS cnt
    FROM (SELECT us.*, v.mode, us.m + v.d AS q FROM us, (VALUES ('pipeline', 0), ('e2e', 1)) v(mode, d)) us
    JOIN types4 t1 ON t1.dataset = us.dataset AND t1.etype = us.etype JOIN types4 t2 ON t2.dataset = us.dataset AND t2.k = (t1.k + 1) % 4
    WHERE (q + p) % 5 <> 0))""", ("us", "types4"))
CTE["pargs"] = ("""pargs AS (SELECT pe.sid, pe.mode, pe.o,
      string_agg('argument>' || a.txt || CASE WHEN (q + p) % 6 = 0 THEN ' zzz' ELSE '' END || '>=' || role, ' | ' ORDER BY k) AS tight,
      string_agg('argument> ' || a.txt || CASE WHEN (q + p) % 6 = 0 THEN ' zzz' ELSE '' END || '>=' || role, ' | ' ORDER BY k) AS loose
    FROM pe JOIN arg a ON a.sid = pe.sid AND a.pos = pe.pos WHERE a.txt <> '' GROUP BY ALL)""", ("pe", "arg"))
CTE["out"] = ("""src AS (SELECT sid, doc_id, dataset, src_id, m, plain FROM sent WHERE sid IN (SELECT sid FROM us)),
  out AS MATERIALIZED (SELECT src.*, coalesce(a, '') AS tc_pipeline, coalesce(b, '') AS tc_e2e, coalesce(c, '') AS e2e_text FROM src
    LEFT JOIN (SELECT sid, string_agg(txt || '=' || ty, ' | ' ORDER BY o) AS a FROM pe WHERE mode = 'pipeline' GROUP BY sid) USING (sid)
    LEFT JOIN (SELECT sid, string_agg('trigger> ' || txt || '>=' || ty, ' | ' ORDER BY o) AS b FROM pe WHERE mode = 'e2e' GROUP BY sid) USING (sid)
    LEFT JOIN (SELECT sid, string_agg('trigger>' || txt || '>=' || ty || coalesce(' | ' || tight, ''), ' || ' ORDER BY o) AS c
      FROM pe LEFT JOIN pargs USING (sid, mode, o) WHERE mode = 'e2e' GROUP BY sid) USING (sid))""", ("sent", "us", "pe", "pargs"))
CTE["ae"] = ("""ae0 AS MATERIALIZED (SELECT sid, mode, o, 'trigger> ' || txt || '>=' || ty || ': ' || concat_ws(' | ', loose, CASE WHEN (q + p) % 2 = 0 THEN 'None=Time' END) AS pred
    FROM pe LEFT JOIN pargs USING (sid, mode, o)),
  ae AS MATERIALIZED (SELECT sid, mode, o, pred FROM ae0 UNION ALL
    SELECT ae0.sid, 'merged', CASE WHEN mode = 'pipeline' THEN o ELSE o + coalesce(np, 0) END, pred FROM ae0
    LEFT JOIN (SELECT sid, count(*) AS np FROM ae0 WHERE mode = 'pipeline' GROUP BY sid) c ON c.sid = ae0.sid)""", ("pe", "pargs"))
CTE["aeref"] = ("""aeref AS MATERIALIZED (SELECT a.sid, 'ref' AS mode, row_number() OVER (PARTITION BY a.sid ORDER BY a.pos) - 1 AS o,
    'trigger> ' || a.txt || '>=' || a.etype || ': ' || coalesce(listed, '') AS pred FROM aeok a LEFT JOIN (
      SELECT sid, pos, string_agg('argument> ' || txt || '>=' || role, ' | ' ORDER BY k) AS listed FROM (SELECT *, row_number() OVER (PARTITION BY sid, pos ORDER BY k) - 1 AS j FROM arg)
      WHERE txt <> '' AND (m + pos + j) % 4 <> 0 GROUP BY ALL) USING (sid, pos))""", ("aeok", "arg"))
CTE["runs"] = (f"""runs AS MATERIALIZED (SELECT sid, plain, run, len, last, sum(len) OVER (PARTITION BY sid ORDER BY ord) - len AS st, ord FROM (
    SELECT sid, plain, run, length(run) AS len, ord, ord = max(ord) OVER (PARTITION BY sid) AS last FROM (
      SELECT sid, plain, unnest(regexp_extract_all(plain, '{W}+|{NW}+')) AS run, generate_subscripts(regexp_extract_all(plain, '{W}+|{NW}+'), 1) AS ord FROM src)))""", ("out",))


def at(text: str, cur: str, cands: str = "cands", plain: str = "plain") -> str:
    """First occurrence at or after ``cur``: several words as substring, one as a whole word (``cands``: its word positions)."""
    mixed = (f"CASE WHEN regexp_matches({text}, '^{W}') THEN '^((?:(?s:.)*?{NW})??)' ELSE '^((?s:.)*?{W})' END || regexp_escape({text}) || "
             f"CASE WHEN regexp_matches({text}, '{W}$') THEN '(?:{NW}|$)' ELSE '{W}' END")
    sub = f"substring({plain}, {cur} + 1)"
    return f"""CASE WHEN contains({text}, ' ') THEN {cur} + nullif(strpos({sub}, {text}), 0) - 1
      WHEN NOT regexp_matches({text}, '^{W}+$') AND regexp_matches({text}, '{W}') THEN CASE WHEN regexp_matches({sub}, {mixed}) THEN {cur} + length(regexp_extract({sub}, {mixed}, 1)) END
      WHEN regexp_matches({text}, '^{W}') AND substring({plain}, {cur} + 1, length({text})) = {text}
        AND NOT regexp_matches(substring({plain}, {cur} + 1 + length({text}), 1), '^{W}') THEN {cur}
      ELSE list_filter({cands}, lambda x: x >= {cur} + CASE WHEN regexp_matches({text}, '^{W}') THEN 0 ELSE 1 END)[1] END"""


def fold(pairs: str, name: str = "fold") -> str:
    """The moving cursor as a recursion over ``pairs(sid, mode, c, text, type)``, ``c`` gapless from 0."""
    return f"""{name}c AS MATERIALIZED (SELECT p.sid, p.mode, p.c, p.text, p.type, any_value(src.plain) AS plain, list_sort(list(r.st) FILTER (WHERE r.st IS NOT NULL)) AS cands FROM {pairs} p JOIN src ON src.sid = p.sid
      LEFT JOIN runs r ON r.sid = p.sid AND r.run = p.text AND (regexp_matches(p.text, '^{W}') OR (r.ord > 1 AND NOT r.last)) GROUP BY ALL),
    {name}(sid, mode, c, cur, text, type, st) AS (
      SELECT DISTINCT sid, mode, -1::BIGINT, 0::BIGINT, ''::VARCHAR, ''::VARCHAR, NULL::BIGINT FROM {pairs}
      UNION ALL SELECT sid, mode, c, CASE WHEN st IS NOT NULL THEN st + length(text) ELSE cur END, text, type, st FROM (
        SELECT p.sid, p.mode, p.c, f.cur, p.text, p.type, ({at('p.text', 'f.cur', 'p.cands', 'p.plain')})::BIGINT AS st
        FROM {name} f JOIN {name}c p ON p.sid = f.sid AND p.mode = f.mode AND p.c = f.c + 1))"""


_STRICT = f"trigger>{WS}*([^\\n]+?){WS}*>={WS}*([^|]+)"
PAIRS = f"""tcs AS (SELECT sid, 'pipeline' AS mode, tc_pipeline AS pred FROM out UNION ALL SELECT sid, 'e2e', tc_e2e FROM out),
  pairs0 AS (SELECT sid, mode, generate_subscripts(xs, 1) AS c, unnest(xs) AS text, unnest(ys) AS type FROM (
      SELECT sid, mode, regexp_extract_all(pred, '{_STRICT}', 1) AS xs, regexp_extract_all(pred, '{_STRICT}', 2) AS ys FROM tcs)
    UNION ALL SELECT sid, mode, c, substring(x, 1, strpos(x, '=') - 1), substring(x, strpos(x, '=') + 1) FROM (
      SELECT sid, mode, c, {strip('x')} AS x FROM (
        SELECT sid, mode, unnest(string_split_regex(pred, '{WS}*\\|{WS}*')) AS x, generate_subscripts(string_split_regex(pred, '{WS}*\\|{WS}*'), 1) AS c
        FROM tcs WHERE len(regexp_extract_all(pred, '{_STRICT}')) = 0)) WHERE contains(x, '=') AND {ws("substring(x, 1, strpos(x, '=') - 1)")} <> ''),
  pairs AS MATERIALIZED (SELECT sid, mode, row_number() OVER (PARTITION BY sid, mode ORDER BY c) - 1 AS c, {spaced(ws('text'))} AS text, {ws('type')} AS type FROM pairs0)"""
TRIG = PAIRS + ",\n  " + fold("pairs") + """,
  t2 AS MATERIALIZED (SELECT sid, mode, c AS pos, text, type, st, st + length(text) - 1 AS en FROM fold WHERE c >= 0),
  tm AS (SELECT sid, text, type, st, en, row_number() OVER (PARTITION BY sid ORDER BY coalesce(st, 0), k) - 1 AS pos FROM (
      SELECT sid, text, type, st, en, min(CASE mode WHEN 'pipeline' THEN pos ELSE 100000 + pos END) AS k FROM t2 GROUP BY ALL)
    WHERE sid IN (SELECT sid FROM (SELECT sid, count(DISTINCT (text, type, st, en)) AS n_all, count(DISTINCT (text, type, st, en)) FILTER (WHERE mode = 'pipeline') AS a,
      count(DISTINCT (text, type, st, en)) FILTER (WHERE mode = 'e2e') AS b FROM t2 GROUP BY sid) WHERE n_all <> a AND n_all <> b)),
  trig AS MATERIALIZED (SELECT sid, mode, pos, text, type, st, en FROM t2 UNION ALL SELECT sid, 'merged', pos, text, type, st, en FROM tm)"""


def place(name: str, inp: str) -> str:
    """Arguments ``inp(sid, mode, o, apos, text, role, ts, te)`` placed next to their trigger, into ``name``."""
    words = "string_split(text, ' ')"
    return f"""{name}0 AS MATERIALIZED (SELECT x.*, src.plain, contains(text, ' ') AS multi, CASE WHEN contains(text, ' ') THEN coalesce(
        list_filter(list_transform(range(len({words}), 0, -1), lambda k: array_to_string({words}[1:k], ' ')), lambda t: contains(src.plain, t))[1], text) ELSE text END AS hit
      FROM {inp} x JOIN src USING (sid)),
    {name}1 AS (SELECT sid, mode, o, apos, min(r.st) AS f, max(r.st) FILTER (WHERE r.st < ts) AS b, min(r.st) FILTER (WHERE r.st > te) AS a
      FROM {name}0 x JOIN runs r USING (sid) WHERE NOT multi AND r.run = x.text AND (regexp_matches(x.text, '^{W}') OR (r.ord > 1 AND NOT r.last)) GROUP BY ALL),
    {name}2 AS (SELECT sid, mode, o, apos, nullif(strpos(plain, hit), 0) - 1 AS f,
        CASE WHEN ts > 0 AND strpos(reverse(left(plain, ts - 1 + length(hit))), reverse(hit)) > 0
          THEN length(left(plain, ts - 1 + length(hit))) - strpos(reverse(left(plain, ts - 1 + length(hit))), reverse(hit)) + 1 - length(hit) END AS b,
        CASE WHEN strpos(substring(plain, te + 2), hit) > 0 THEN te + strpos(substring(plain, te + 2), hit) END AS a FROM {name}0 WHERE multi),
    {name} AS MATERIALIZED (SELECT sid, mode, o, apos, hit AS text, role, st, st + length(hit) - 1 AS en FROM (
      SELECT x.*, CASE WHEN ts IS NULL THEN f WHEN b IS NOT NULL AND a IS NOT NULL THEN CASE WHEN ts - b <= a - te THEN b ELSE a END ELSE coalesce(b, a, f) END AS st
      FROM {name}0 x LEFT JOIN (SELECT * FROM {name}1 UNION ALL SELECT * FROM {name}2) USING (sid, mode, o, apos)))"""


def ae_items(name: str, preds: str) -> str:
    """Argument parts of predictions ``preds(sid, mode, o, pred)``: text and role, in order."""
    body = "CASE WHEN contains(pred, ': ') THEN substring(pred, strpos(pred, ': ') + 2) ELSE pred END"
    marked = f"^argument>{WS}*([^\\n]+?){WS}*>={WS}*([^\\n]+)"
    loose = rf"^([^\s\x1C-\x1F\x{{85}}\p{{Z}}]+?){WS}*={WS}*([^\n]+)"
    return f"""{name}p AS (SELECT sid, mode, o, c, {strip('x')} AS x FROM (SELECT sid, mode, o, unnest(string_split_regex(b, '{WS}*\\|{WS}*')) AS x,
        generate_subscripts(string_split_regex(b, '{WS}*\\|{WS}*'), 1) AS c FROM (SELECT sid, mode, o, {strip(body)} AS b FROM {preds}))),
    {name} AS MATERIALIZED (SELECT sid, mode, o, row_number() OVER (PARTITION BY sid, mode, o ORDER BY c) - 1 AS apos, {spaced('text')} AS text, role FROM (
      SELECT sid, mode, o, c, {ws(f"regexp_extract(x, '{marked}', 1)")} AS text, {ws(f"regexp_extract(x, '{marked}', 2)")} AS role FROM {name}p WHERE regexp_matches(x, '{marked}')
      UNION ALL SELECT sid, mode, o, c, {ws(f"regexp_extract(x, '{loose}', 1)")}, {ws(f"regexp_extract(x, '{loose}', 2)")} FROM {name}p
        WHERE NOT regexp_matches(x, '{marked}') AND regexp_matches(x, '{loose}') AND lower({ws(f"regexp_extract(x, '{loose}', 1)")}) <> 'none'))"""


ARGS = TRIG + ",\n  " + ae_items("items", "ae") + """,
  anchored AS (SELECT i.sid, i.mode, i.o, apos, i.text, role, t.st AS ts, t.en AS te FROM items i JOIN trig t ON t.sid = i.sid AND t.mode = i.mode AND t.pos = i.o),
  """ + place("args", "anchored")

_TMARK, _AMARK = (f"^{k}>{WS}*([^\\n]+?){WS}*>={WS}*([^\\n]+)" for k in ("trigger", "argument"))
E2E = f"""grp AS (SELECT sid, unnest(string_split(e2e_text, '||')) AS grp, generate_subscripts(string_split(e2e_text, '||'), 1) AS g FROM out),
  cmp0 AS (SELECT sid, g, {strip('x')} AS x, c FROM (SELECT sid, g, unnest(string_split(grp, '|')) AS x, generate_subscripts(string_split(grp, '|'), 1) AS c FROM grp)),
  cmp AS MATERIALIZED (SELECT sid, g, c, 1 AS kind, {ws(f"regexp_extract(x, '{_TMARK}', 1)")} AS text, {ws(f"regexp_extract(x, '{_TMARK}', 2)")} AS label FROM cmp0
      WHERE contains(x, 'trigger>') AND regexp_matches(x, '{_TMARK}')
    UNION ALL SELECT sid, g, c, 2, {ws(f"regexp_extract(x, '{_AMARK}', 1)")}, {ws(f"regexp_extract(x, '{_AMARK}', 2)")} FROM cmp0
      WHERE NOT contains(x, 'trigger>') AND regexp_matches(x, '{_AMARK}')),
  epairs AS MATERIALIZED (SELECT sid, 'x' AS mode, row_number() OVER (PARTITION BY sid ORDER BY g, c) - 1 AS c, text, label AS type, g, c AS c0 FROM cmp WHERE kind = 1),
  {fold('epairs', 'efold')},
  et AS MATERIALIZED (SELECT e.sid, e.g, e.c0, f.text, f.type, f.st, f.st + length(f.text) - 1 AS en FROM efold f JOIN epairs e USING (sid, mode, c)),
  eg AS MATERIALIZED (SELECT sid, g, row_number() OVER (PARTITION BY sid ORDER BY g) - 1 AS pos, text, type, st, en FROM et QUALIFY row_number() OVER (PARTITION BY sid, g ORDER BY c0 DESC) = 1),
  eanch AS (SELECT a.sid, 'x' AS mode, eg.pos AS o, row_number() OVER (PARTITION BY a.sid, a.g ORDER BY a.c) - 1 AS apos, a.text, a.label AS role,
      arg_max(t.st, t.c0) AS ts0, a.c, a.g FROM cmp a JOIN eg USING (sid, g) LEFT JOIN et t ON t.sid = a.sid AND t.g = a.g AND t.c0 < a.c
    WHERE a.kind = 2 AND lower(a.text) <> 'none' GROUP BY a.sid, eg.pos, a.text, a.label, a.c, a.g),
  eanch2 AS (SELECT e.sid, e.mode, e.o, e.apos, e.text, e.role, t.st AS ts, t.en AS te FROM eanch e
    LEFT JOIN et t ON t.sid = e.sid AND t.g = e.g AND t.c0 = (SELECT max(c0) FROM et u WHERE u.sid = e.sid AND u.g = e.g AND u.c0 < e.c)),
  {place('eargs', 'eanch2')}"""


def rsql(body, *names, extra=""):
    return sql(body, *names, "runs", extra=extra, recursive=True)


def flat_triggers(df, col, *keys):
    return df.select(*keys, F.posexplode(col).alias("pos", "t")).select(
        *keys, F.col("pos").cast("long").alias("pos"), "t.text", "t.type", F.col("t.start").cast("long").alias("start"), F.col("t.end").cast("long").alias("end"))


def flat_events(df, col, *keys):
    """Events and arguments as one flat table: ``apos`` is -1 for the trigger row."""
    ev = df.select(*keys, F.posexplode(col).alias("pos", "e"))
    rows = F.concat(
        F.array(F.struct(F.lit(-1).alias("apos"), F.col("e.trigger.text").alias("text"), F.col("e.trigger.type").alias("label"),
                         F.col("e.trigger.start").alias("start"), F.col("e.trigger.end").alias("end"))),
        F.transform("e.arguments", lambda a, i: F.struct(i.alias("apos"), a["text"].alias("text"), a["role"].alias("label"), a["start"].alias("start"), a["end"].alias("end"))))
    return ev.select(*keys, F.col("pos").cast("long").alias("pos"), F.explode(rows).alias("r")).select(
        *keys, "pos", F.col("r.apos").cast("long").alias("apos"), "r.text", "r.label", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"))


# ---- offsets (T9-T12, J12, W9) --------------------------------------------------------------------
query("t9_positions", """SELECT doc_id, count(*) AS n, min(p0) AS first, max(p0) AS last FROM (
      SELECT doc_id, (sum(length(x) + 2) OVER (PARTITION BY doc_id ORDER BY i) - 2)::BIGINT AS p0, i, k FROM (
        SELECT doc_id, unnest(string_split(text, 'en')) AS x, generate_subscripts(string_split(text, 'en'), 1) AS i, len(string_split(text, 'en')) AS k FROM documents)) WHERE i < k GROUP BY doc_id""")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", O.substring_positions(F.col("text"), F.lit("en")).alias("ps")).where(F.size("ps") > 0).select(
        "doc_id", F.size("ps").cast("long").alias("n"), F.element_at("ps", 1).cast("long").alias("first"), F.element_at("ps", -1).cast("long").alias("last")))

query("t10_word_positions", sql(f"""SELECT doc_id, p, string_agg(st, ' ' ORDER BY st) AS positions FROM (
      SELECT us.doc_id, us.p, st FROM us JOIN runs USING (sid) WHERE run = txt
      UNION ALL SELECT doc_id, p, unnest(list_filter(range(0, length(plain) - length(txt) + 1), lambda i: substring(plain, i + 1, length(txt)) = txt
        AND regexp_matches(CASE WHEN i = 0 THEN '' ELSE substring(plain, i, 1) END, '^{W}') <> regexp_matches(txt, '^{W}')
        AND regexp_matches(substring(plain, i + 1 + length(txt), 1), '^{W}') <> regexp_matches(txt, '{W}$')))
      FROM (SELECT us.*, plain FROM us JOIN (SELECT sid, plain FROM src) USING (sid)) WHERE NOT contains(txt, ' ') AND NOT regexp_matches(txt, '^{W}+$')) GROUP BY ALL""", "us", "out", "runs"))(
    lambda spark, sf: _gold_spans(spark, sf).select("doc_id", "p", O.word_positions(F.col("source"), F.col("text")).alias("ps")).where(
        (F.size("ps") > 0)).select("doc_id", "p", F.array_join(F.transform("ps", lambda x: x.cast("string")), " ").alias("positions")))


def _gold_spans(spark, sf):
    from spanloom.operators.spans import enrich
    return enrich(corpus(spark, sf)).select("doc_id", F.col("plain").alias("source"), F.posexplode("uspans").alias("p", "x")).select(
        "doc_id", "source", F.col("p").cast("long").alias("p"), "x.text").where(~F.contains("text", F.lit(" ")))


query("t11_word_from", sql(f"""SELECT doc_id, p, coalesce({at('txt', '40')}, -1)::BIGINT AS hit FROM (
      SELECT us.doc_id, us.p, us.txt, any_value(plain) AS plain, list_sort(list(st) FILTER (WHERE st IS NOT NULL)) AS cands FROM us JOIN src ON src.sid = us.sid
      LEFT JOIN (SELECT sid, run, st FROM runs) r ON r.sid = us.sid AND run = txt WHERE NOT contains(txt, ' ') AND length(plain) >= 40
      GROUP BY us.doc_id, us.p, us.txt)""", "us", "out", "runs"))(
    lambda spark, sf: _gold_spans(spark, sf).where(F.length("source") >= 40).select("doc_id", "p", O.first_word_from(F.col("source"), F.col("text"), 40).cast("long").alias("hit")))

query("t12_trim_fallback", sql("""SELECT a.doc_id, a.pos, a.k - (SELECT min(k) FROM arg b WHERE b.sid = a.sid AND b.pos = a.pos) AS dk, list_filter(list_transform(range(len(w), 0, -1), lambda k: array_to_string(w[1:k], ' ')),
      lambda t: contains(plain, t))[1] AS text FROM (SELECT *, string_split(txt || ' zzz', ' ') AS w FROM arg) a JOIN (SELECT sid, plain FROM sent) USING (sid)""", "arg"))(
    lambda spark, sf: _gold_args(spark, sf).select("doc_id", "pos", "dk", O.trim_fallback(F.col("source"), F.concat("text", F.lit(" zzz"))).alias("text")))


def _gold_args(spark, sf):
    from spanloom.operators.spans import enrich
    a = enrich(corpus(spark, sf)).select("doc_id", "sid", "src_id", F.col("plain").alias("source"), F.explode("mentions").alias("m"))
    # The distance in slot number between kept arguments is two: slots of one parity are kept.
    return a.select("doc_id", "source", F.col("m.pos").cast("long").alias("pos"), F.posexplode("m.args").alias("j", "a")).select(
        "doc_id", "source", "pos", (F.col("j") * 2).cast("long").alias("dk"), "a.text")


_J12 = """anch AS (SELECT a.sid, 'x' AS mode, a.pos AS o, a.k AS apos, a.txt AS text, a.role, strpos(plain, ev.txt) - 1 AS ts, strpos(plain, ev.txt) + length(ev.txt) - 2 AS te
    FROM arg a JOIN ev USING (sid, pos) JOIN (SELECT sid, plain FROM sent) USING (sid) WHERE valid AND a.txt <> '' AND NOT contains(a.txt, ' ') AND contains(plain, ev.txt)), """ + place("np", "anch")
query("j12_nearest", sql("SELECT doc_id, o AS pos, role, text, coalesce(st, -1)::BIGINT AS hit FROM np JOIN (SELECT sid, doc_id FROM sent) USING (sid)", "arg", "ev", "out", "runs", extra=_J12))(
    lambda spark, sf: _j12(spark, sf))


def _j12(spark, sf):
    from spanloom.operators.spans import enrich, has_span
    a = enrich(has_span(corpus(spark, sf))).select("doc_id", F.col("plain").alias("source"), F.explode(F.filter("mentions", lambda m: m["valid"])).alias("m"))
    a = a.select("doc_id", "source", F.col("m.pos").cast("long").alias("pos"), F.col("m.text").alias("tt"), F.explode("m.args").alias("a")).where(
        (F.col("a.text") != "") & ~F.contains("a.text", F.lit(" "))).withColumn("ts", O.find(F.col("source"), F.col("tt"))).where(F.col("ts") >= 0)
    return a.select("doc_id", "pos", "a.role", "a.text", O.nearest_word(F.col("source"), F.col("a.text"), F.col("ts"), F.col("ts") + F.length("tt") - 1).cast("long").alias("hit"))


# ---- T19 / X1-X6 -----------------------------------------------------------------------------------
_T19 = r"trigger>\s*([^\n]*?)\s*>?=\s*"
query("t19_ae_trigger", sql(rf"""SELECT doc_id, o, {strip(f"regexp_extract(pred, '{_T19}([^:|]+)', 1)")} AS text, {strip(f"regexp_extract(pred, '{_T19}((?:[^:|]|:[^ |:])+)', 2)")} AS type,
      {strip(f"regexp_extract(pred, '{_T19}([^:|]+)', 2)")} AS compat_type FROM ae JOIN (SELECT sid, doc_id FROM sent) USING (sid) WHERE mode = 'pipeline'""", "sent", "ae"))(
    lambda spark, sf: outputs(spark, sf).select("doc_id", F.posexplode("ae_pipeline").alias("o", "p")).select(
        "doc_id", F.col("o").cast("long").alias("o"), T.ae_trigger(F.col("p"))[0].alias("text"), T.ae_trigger(F.col("p"))[1].alias("type"),
        T.ae_trigger(F.col("p"), True)[1].alias("compat_type")))

_TI = f"""wu AS (SELECT sid, {clean("body || ' ' || array_to_string(tokens[last_e + 1:], ' ')")} AS tagged FROM (
    SELECT sid, string_agg(array_to_string(tokens[uprev + 1:s], ' ') || ' trigger> ' || txt || '>', ' ' ORDER BY p) AS body, max_by(e, p) AS last_e
    FROM us JOIN (SELECT sid, tokens FROM sent) USING (sid) GROUP BY sid) JOIN (SELECT sid, tokens FROM sent) USING (sid)),
  h1 AS (SELECT sid, doc_id, plain, generate_subscripts(xs, 1) - 1 AS c, {ws('unnest(xs)')} AS t FROM (
    SELECT sid, doc_id, plain, regexp_extract_all(tagged, '(?s)trigger>{WS}*(.+?){WS}*>', 1) AS xs FROM wu JOIN sent USING (sid)))"""
query("x1_tagged_triggers", sql(f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS pos, t AS text, nullif(strpos({strip('plain')}, t), 0) - 1 AS start,
    nullif(strpos({strip('plain')}, t), 0) + length(t) - 2 AS "end" FROM h1 WHERE t <> ''""", "us", extra=_TI))(
    lambda spark, sf: outputs(spark, sf).select("doc_id", F.posexplode(X.tagged_triggers(P.identification_prompt(F.col("dataset"), F.col("source")), F.col("ti"))).alias("pos", "x")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "x.text", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end")))

_X2 = f"""tcs AS (SELECT sid, 'pipeline' AS mode, tc_pipeline AS pred FROM out UNION ALL SELECT sid, 'e2e', tc_e2e FROM out),
  body AS (SELECT sid, mode, CASE WHEN strpos(lower(pred), 'trigger>') > 0 THEN {strip("substring(pred, strpos(lower(pred), 'trigger>'))")} ELSE pred END AS b FROM tcs),
  it AS (SELECT sid, mode, c, {strip('x')} AS x FROM (SELECT sid, mode, unnest(string_split_regex(b, '{WS}*\\|{WS}*')) AS x, generate_subscripts(string_split_regex(b, '{WS}*\\|{WS}*'), 1) AS c FROM body)),
  pr AS (SELECT sid, mode, c, CASE WHEN regexp_matches(x, '{{s}}') THEN {ws("regexp_extract(x, '{s}', 1)")}
      WHEN regexp_matches(lf, '{{i}}') THEN {ws("regexp_extract(lf, '{i}', 1)")} WHEN starts_with(lower({strip('lf')}), 'none') THEN NULL ELSE {ws('lf')} END AS text,
      CASE WHEN regexp_matches(x, '{{s}}') THEN {ws("regexp_extract(x, '{s}', 2)")} ELSE {ws("substring(x, strpos(x, '=') + 1)")} END AS type
    FROM (SELECT *, substring(x, 1, strpos(x, '=') - 1) AS lf FROM it WHERE contains(x, '=')))""".replace("{s}", f"trigger>{WS}*([^\\n]+?){WS}*>={WS}*([^\\n]+)$").replace(
    "{i}", f"trigger>{WS}*([^\\n]+)$").replace("{{", "{").replace("}}", "}")
_X2 = _X2.replace("'{trigger>", "'trigger>").replace("$}'", "$'")
query("x2_tc_pairs", sql("""SELECT doc_id, mode, row_number() OVER (PARTITION BY sid, mode ORDER BY c) - 1 AS pos, text, type FROM (
    SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY sid, mode, text ORDER BY c) = 1) JOIN (SELECT sid, doc_id FROM src) USING (sid)""", "out", extra=_X2))(
    lambda spark, sf: _pairs(spark, sf).select("doc_id", "mode", F.col("pos").cast("long").alias("pos"), "x.text", "x.type"))


def _pairs(spark, sf):
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"tc_{m}").alias("pred")) for m in ("pipeline", "e2e")])).alias("p")
    return outputs(spark, sf).select("dataset", "doc_id", modes).select("dataset", "doc_id", "p.mode", F.posexplode(X.classification_pairs(F.col("p.pred"))).alias("pos", "x"))


query("x2_tc_hits", sql(f"""SELECT doc_id, c - 1 AS pos, {ws('sp')} AS text, {ws('cl')} AS type,
      (sum(length(pre) + length(hit)) OVER (PARTITION BY sid ORDER BY c) - length(hit) + 8 + length(gap))::BIGINT AS start,
      (sum(length(pre) + length(hit)) OVER (PARTITION BY sid ORDER BY c) - length(hit) + 8 + length(gap) + length(sp) - 1)::BIGINT AS "end"
    FROM (SELECT sid, doc_id, generate_subscripts(hits, 1) AS c, unnest(hits) AS hit, unnest(gaps) AS gap, unnest(sps) AS sp, unnest(cls) AS cl, unnest(pres) AS pre FROM (
      SELECT sid, doc_id, regexp_extract_all(b, '(?s)trigger>{WS}*.+?{WS}*>={WS}*[^|<]+') AS hits, regexp_extract_all(b, '(?s)trigger>({WS}*)(.+?){WS}*>={WS}*([^|<]+)', 1) AS gaps,
        regexp_extract_all(b, '(?s)trigger>({WS}*)(.+?){WS}*>={WS}*([^|<]+)', 2) AS sps, regexp_extract_all(b, '(?s)trigger>({WS}*)(.+?){WS}*>={WS}*([^|<]+)', 3) AS cls,
        regexp_extract_all(b, '(?s)(.*?)trigger>{WS}*.+?{WS}*>={WS}*[^|<]+', 1) AS pres FROM (SELECT sid, doc_id, {strip('tc_e2e')} AS b FROM out WHERE tc_e2e <> '')))""", "out"))(
    lambda spark, sf: outputs(spark, sf).select("doc_id", F.posexplode(X.classification_hits(F.col("tc_e2e"))).alias("pos", "x")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "x.text", "x.type", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end")))

query("a12_unrecognised", sql("""SELECT dataset, doc_id, count(*) FILTER (WHERE d.event_type IS NULL) AS unrecognised, count(*) AS predicted FROM (
    SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY sid, mode, text ORDER BY c) = 1) JOIN (SELECT sid, doc_id, dataset FROM src) USING (sid)
    LEFT JOIN dim_types d USING (dataset) WHERE d.event_type = type GROUP BY ALL""".replace("LEFT JOIN dim_types d USING (dataset) WHERE d.event_type = type",
    "LEFT JOIN (SELECT dataset AS ds, event_type FROM dim_types) d ON d.ds = dataset AND d.event_type = type"), "out", "dim_types", extra=_X2))(
    lambda spark, sf: X.unrecognised(_pairs(spark, sf).select("dataset", "doc_id", "x.*"), ONTO))

_X3 = f"""b3 AS (SELECT sid, o, {strip("substring(pred, strpos(pred, 'trigger>') + strpos(substring(pred, strpos(pred, 'trigger>')), ':'))")} AS b FROM ae WHERE mode = 'pipeline'),
  i3 AS (SELECT sid, o, c, {strip('x')} AS x FROM (SELECT sid, o, unnest(string_split_regex(b, '{WS}*\\|{WS}*')) AS x, generate_subscripts(string_split_regex(b, '{WS}*\\|{WS}*'), 1) AS c FROM b3)),
  p3 AS (SELECT sid, o, c, CASE WHEN regexp_matches(x, '#n') THEN NULL WHEN regexp_matches(x, '#s') THEN {ws("regexp_extract(x, '#s', 1)")}
      WHEN regexp_matches(lf, '#i') THEN {ws("regexp_extract(lf, '#i', 1)")} ELSE {ws('lf')} END AS text,
      CASE WHEN regexp_matches(x, '#n') THEN {ws("regexp_extract(x, '#n', 1)")} WHEN regexp_matches(x, '#s') THEN {ws("regexp_extract(x, '#s', 2)")} ELSE {ws("substring(x, strpos(x, '=') + 1)")} END AS role
    FROM (SELECT *, substring(x, 1, strpos(x, '=') - 1) AS lf FROM i3 WHERE contains(x, '=')))""".replace("#n", f"^None{WS}*={WS}*([^\\n]+)$").replace(
    "#s", f"argument>{WS}*([^\\n]+?){WS}*>={WS}*([^\\n]+)$").replace("#i", f"argument>{WS}*([^\\n]+)$")
query("x3_ai_pairs", sql("""SELECT doc_id, o, row_number() OVER (PARTITION BY sid, o ORDER BY c) - 1 AS pos, text, role FROM (
    SELECT * FROM p3 QUALIFY row_number() OVER (PARTITION BY sid, o, text, role ORDER BY c) = 1) JOIN (SELECT sid, doc_id FROM sent) USING (sid)""", "sent", "ae", extra=_X3))(
    lambda spark, sf: outputs(spark, sf).select("doc_id", F.posexplode("ae_pipeline").alias("o", "p")).select(
        "doc_id", F.col("o").cast("long").alias("o"), F.posexplode(X.argument_pairs(F.col("p"))).alias("pos", "x")).select(
        "doc_id", "o", F.col("pos").cast("long").alias("pos"), "x.text", "x.role"))

_X4 = f"""src4 AS (SELECT sid, doc_id, 'Domain: ' || dataset || '. Classify trigger types end-to-end. ' AS pre, {strip('plain')} AS body, tc_e2e FROM out),
  i4 AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY c) - 1 AS pos, {strip("substring(x, 1, strpos(x, '>=') - 1)")} AS text, {strip("substring(x, strpos(x, '>=') + 2)")} AS type FROM (
    SELECT sid, c, {strip("substring(x, strpos(x, 'trigger>') + 8)")} AS x FROM (SELECT sid, unnest(string_split(tc_e2e, '|')) AS x, generate_subscripts(string_split(tc_e2e, '|'), 1) AS c FROM src4)
    WHERE contains(x, 'trigger>')) WHERE contains(x, '>=')),
  k4 AS (SELECT *, row_number() OVER (PARTITION BY sid, text ORDER BY pos) AS k FROM i4),
  occ(sid, text, k, a0, kmax) AS (SELECT sid, text, 0, -1::BIGINT, max(k) FROM k4 GROUP BY sid, text
    UNION ALL SELECT o.sid, o.text, o.k + 1, o.a0 + strpos(substring(body, o.a0 + 2), o.text), kmax FROM occ o JOIN src4 USING (sid)
      WHERE o.k < kmax AND strpos(substring(body, o.a0 + 2), o.text) > 0)"""
query("x4_e2e_triggers", rsql("""SELECT doc_id, pos, k4.text, type, length(pre) + a0 AS start, length(pre) + a0 + length(k4.text) AS stop
    FROM k4 JOIN src4 USING (sid) LEFT JOIN occ ON occ.sid = k4.sid AND occ.text = k4.text AND occ.k = k4.k""", "out", extra=_X4))(
    lambda spark, sf: outputs(spark, sf).select("doc_id", F.posexplode(X.e2e_triggers(P.direct_classification_prompt(F.col("dataset"), F.col("source")), F.col("tc_e2e"))).alias("pos", "x")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "x.text", "x.type", F.col("x.start").cast("long").alias("start"), F.col("x.stop").cast("long").alias("stop")))

query("w9_kth_occurrence", rsql("""SELECT doc_id, text, max(k) AS predicted, count(a0) AS placed FROM (SELECT k4.sid, k4.text, k4.k, occ.a0 FROM k4
    LEFT JOIN occ ON occ.sid = k4.sid AND occ.text = k4.text AND occ.k = k4.k) JOIN (SELECT sid, doc_id FROM src4) USING (sid) GROUP BY ALL""", "out", extra=_X4))(
    lambda spark, sf: outputs(spark, sf).select("doc_id", F.explode(X.e2e_triggers(P.direct_classification_prompt(F.col("dataset"), F.col("source")), F.col("tc_e2e"))).alias("x")).groupBy(
        "doc_id", "x.text").agg(F.count("*").alias("predicted"), F.count("x.start").alias("placed")))

_X5 = f"""pm AS (SELECT sid, o, 'Domain: ' || dataset || '. Extract arguments for a specific event. argument> Agent | Place for trigger> ' || txt || '>=' || ty || ': ' AS pre, plain, pred
    FROM ae JOIN pe USING (sid, mode, o) JOIN (SELECT sid, plain FROM sent) USING (sid) WHERE mode = 'pipeline'),
  q5 AS (SELECT sid, o, pre || plain AS prompt, {strip("substring(pred, strpos(pred, ': ') + 2)")} AS b FROM pm),
  i5 AS (SELECT sid, o, prompt, c, {strip("string_split(x, 'argument>')[2]")} AS x FROM (
    SELECT sid, o, prompt, {strip('x')} AS x, c FROM (SELECT sid, o, prompt, unnest(string_split(b, ' | ')) AS x, generate_subscripts(string_split(b, ' | '), 1) AS c FROM q5))
    WHERE contains(x, 'argument>') AND NOT contains(lower(x), 'none=')),
  r5 AS (SELECT sid, o, row_number() OVER (PARTITION BY sid, o ORDER BY c) - 1 AS pos, {strip("substring(x, 1, strpos(x, '>=') - 1)")} AS text, {strip("substring(x, strpos(x, '>=') + 2)")} AS role, prompt,
      strpos(prompt, 'for trigger> ') AS mk FROM i5 WHERE contains(x, '>=')),
  s5 AS (SELECT *, mk + strpos(substring(prompt, mk), '>=') - 1 AS ge FROM r5),
  u5 AS (SELECT *, ge + strpos(substring(prompt, ge), ': ') AS base FROM s5)"""
query("x5_ae_pairs", sql("""SELECT doc_id, o, pos, text, role, base + nullif(strpos(substring(prompt, base + 1), text), 0) - 1 AS start,
    base + nullif(strpos(substring(prompt, base + 1), text), 0) - 1 + length(text) AS stop FROM u5 JOIN (SELECT sid, doc_id FROM sent) USING (sid)""", "sent", "ae", "pe", extra=_X5))(
    lambda spark, sf: _x5(spark, sf))


def _x5(spark, sf):
    heads = F.regexp_extract("p", r"^(trigger> [^\n]*?>=[^\n]*?): ", 1)
    # The prompt repeats the trigger and type of the prediction, so it is rebuilt from the prediction's head.
    df = outputs(spark, sf).select("doc_id", "dataset", "source", F.posexplode("ae_pipeline").alias("o", "p")).withColumn("prompt", F.concat(
        F.lit("Domain: "), "dataset", F.lit(". Extract arguments for a specific event. argument> Agent | Place for "), heads, F.lit(": "), "source"))
    return df.select("doc_id", F.col("o").cast("long").alias("o"), F.posexplode(X.extraction_pairs(F.col("prompt"), F.col("p"))).alias("pos", "x")).select(
        "doc_id", "o", F.col("pos").cast("long").alias("pos"), "x.text", "x.role", F.col("x.start").cast("long").alias("start"), F.col("x.stop").cast("long").alias("stop"))


_X6 = f"""g6 AS (SELECT sid, plain, length('domain: ' || dataset || '. Event trigger and argument extraction. ') AS base, {strip('plain')} AS body, {strip('x')} AS grp, g FROM (
    SELECT *, unnest(string_split(e2e_text, ' || ')) AS x, generate_subscripts(string_split(e2e_text, ' || '), 1) AS g FROM out)),
  h6 AS (SELECT * EXCLUDE (g), dense_rank() OVER (PARTITION BY sid ORDER BY g) - 1 AS g FROM g6 WHERE grp <> ''),
  c6 AS (SELECT sid, base, body, g, c, contains(x, 'trigger>') AS is_t, CASE WHEN contains(x, 'trigger>') THEN substring(x, strpos(x, 'trigger>') + 8)
      WHEN contains(x, 'argument>') THEN substring(x, strpos(x, 'argument>') + 9) END AS content FROM (
    SELECT sid, base, body, g, unnest(string_split(grp, ' | ')) AS x, generate_subscripts(string_split(grp, ' | '), 1) AS c FROM h6)),
  d6 AS MATERIALIZED (SELECT sid, base, body, g, c, is_t, {strip("substring(content, 1, strpos(content, '>=') - 1)")} AS text, {strip("substring(content, strpos(content, '>=') + 2)")} AS label
    FROM c6 WHERE contains(content, '>=')),
  t6 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid, text ORDER BY g, c) AS rep FROM d6 WHERE is_t) WHERE rep = 1 OR NOT contains(body, text)),
  e6 AS (SELECT * FROM t6 QUALIFY row_number() OVER (PARTITION BY sid, g ORDER BY c DESC) = 1),
  r6 AS (SELECT sid, base, body, g, -1 AS apos, text, label FROM e6 UNION ALL
    SELECT sid, base, body, g, row_number() OVER (PARTITION BY sid, g ORDER BY c) - 1, text, label FROM d6 WHERE NOT is_t AND lower(text) <> 'none' AND (sid, g) IN (SELECT (sid, g) FROM e6))"""
query("x6_e2e_events_eval", sql("""SELECT doc_id, g AS grp, apos, text, label, base + nullif(strpos(body, text), 0) - 1 AS start, base + nullif(strpos(body, text), 0) - 1 + length(text) AS stop
    FROM r6 JOIN (SELECT sid, doc_id FROM src) USING (sid)""", "out", extra=_X6))(lambda spark, sf: _x6(spark, sf))


def _x6(spark, sf):
    ev = outputs(spark, sf).select("doc_id", F.explode(X.e2e_events_eval(P.e2e_prompt(F.col("dataset"), F.col("source")), F.col("e2e_text"))).alias("e"))
    rows = F.concat(
        F.array(F.struct(F.lit(-1).alias("apos"), F.col("e.trigger").alias("x"))),
        F.transform("e.arguments", lambda a, i: F.struct(i.alias("apos"), a.alias("x"))))
    return ev.select("doc_id", F.col("e.group").cast("long").alias("grp"), F.explode(rows).alias("r")).select(
        "doc_id", "grp", F.col("r.apos").cast("long").alias("apos"), "r.x.text", "r.x.label", F.col("r.x.start").cast("long").alias("start"), F.col("r.x.stop").cast("long").alias("stop"))


# ---- X7-X12, U3, F5, C13 -----------------------------------------------------------------------------
def detected(spark, sf):
    return X.detect(outputs(spark, sf))


_OUT_T = "SELECT doc_id, pos, text, type, st AS start, en AS \"end\" FROM {t} JOIN (SELECT sid, doc_id FROM src) USING (sid)"
query("x7_serving_triggers", rsql(_OUT_T.format(t="t2").replace("doc_id, pos", "doc_id, mode, pos", 1), "out", extra=TRIG))(
    lambda spark, sf: flat_triggers(detected(spark, sf), "t_pipeline", "doc_id").withColumn("mode", F.lit("pipeline")).unionByName(
        flat_triggers(detected(spark, sf), "t_e2e", "doc_id").withColumn("mode", F.lit("e2e"))))
query("w8_cursor_offsets", rsql("SELECT doc_id, mode, count(*) AS n, count(st) AS placed, coalesce(max(en), -1)::BIGINT AS reach FROM t2 JOIN (SELECT sid, doc_id FROM src) USING (sid) GROUP BY ALL",
                                "out", extra=TRIG))(
    lambda spark, sf: outputs(spark, sf).select("doc_id", F.explode(F.array(*[F.struct(
        F.lit(m).alias("mode"), X.serving_triggers(F.col("source"), F.col(f"tc_{m}")).alias("ts")) for m in ("pipeline", "e2e")])).alias("x")).where(F.size("x.ts") > 0).select(
        "doc_id", "x.mode", F.size("x.ts").cast("long").alias("n"), F.size(X.valid_offsets(F.col("x.ts"))).cast("long").alias("placed"),
        F.coalesce(F.array_max(F.transform("x.ts", lambda t: t["end"])), F.lit(-1)).cast("long").alias("reach")))
query("u3_merge_modes", rsql(_OUT_T.format(t="tm"), "out", extra=TRIG))(lambda spark, sf: flat_triggers(detected(spark, sf), "t_merged", "doc_id"))
query("o2_merged_sort", rsql("SELECT doc_id, string_agg(coalesce(st, 0), ' ' ORDER BY pos) AS starts FROM tm JOIN (SELECT sid, doc_id FROM src) USING (sid) GROUP BY doc_id", "out", extra=TRIG))(
    lambda spark, sf: detected(spark, sf).where(F.size("t_merged") > 0).select("doc_id", F.array_join(F.transform("t_merged", lambda t: F.coalesce(t["start"], F.lit(0)).cast("string")), " ").alias("starts")))
query("x10_detection_merge", rsql("""SELECT doc_id, coalesce(a, 0) AS n_pipeline, coalesce(b, 0) AS n_e2e, coalesce(c, 0) AS n_merged FROM src LEFT JOIN (
    SELECT sid, count(*) FILTER (WHERE mode = 'pipeline') AS a, count(*) FILTER (WHERE mode = 'e2e') AS b, count(*) FILTER (WHERE mode = 'merged') AS c FROM trig GROUP BY sid) USING (sid)""", "out", extra=TRIG))(
    lambda spark, sf: detected(spark, sf).select("doc_id", *[F.size(f"t_{m}").cast("long").alias(f"n_{m}") for m in ("pipeline", "e2e", "merged")]))
query("f5_valid_offsets", rsql("SELECT doc_id, mode, pos, text FROM trig JOIN (SELECT sid, doc_id FROM src) USING (sid) WHERE st IS NOT NULL", "out", extra=TRIG))(
    lambda spark, sf: _f5(spark, sf))


def _f5(spark, sf):
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.transform(f"t_{m}", lambda t, i: F.struct(
        i.alias("pos"), t["text"].alias("text"), t["start"].alias("start"), t["end"].alias("end"))).alias("ts")) for m in ("pipeline", "e2e", "merged")])).alias("x")
    return detected(spark, sf).select("doc_id", modes).select("doc_id", "x.mode", F.explode(X.valid_offsets(F.col("x.ts"))).alias("t")).select(
        "doc_id", "mode", F.col("t.pos").cast("long").alias("pos"), "t.text")


query("x8_serving_arguments", rsql("""SELECT doc_id, mode, o AS pos, apos, text, role AS label, st AS start, en AS "end" FROM args JOIN (SELECT sid, doc_id FROM src) USING (sid)""",
                                   "out", "ae", "runs", extra=ARGS))(
    lambda spark, sf: _mode_events(spark, sf).where(F.col("apos") >= 0))


def _mode_events(spark, sf):
    r = runs(spark, sf)
    by = r.select("doc_id", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("evs")) for m in ("pipeline", "e2e", "merged")])).alias("x"))
    return flat_events(by.select("doc_id", "x.mode", "x.evs"), "evs", "doc_id", "mode")


query("x11_structure_events", rsql("""SELECT doc_id, mode, pos, apos, text, label, st AS start, en AS "end" FROM (
      SELECT sid, mode, pos, -1 AS apos, text, type AS label, st, en FROM trig UNION ALL SELECT sid, mode, o, apos, text, role, st, en FROM args) JOIN (SELECT sid, doc_id FROM src) USING (sid)""",
                                   "out", "ae", "runs", extra=ARGS))(_mode_events)
query("j8_zip_predictions", rsql("""SELECT doc_id, mode, pos, coalesce(n, 0) AS n_args FROM trig LEFT JOIN (SELECT sid, mode, o AS pos, count(*) AS n FROM args GROUP BY ALL) USING (sid, mode, pos)
    JOIN (SELECT sid, doc_id FROM src) USING (sid)""", "out", "ae", "runs", extra=ARGS))(
    lambda spark, sf: _mode_events(spark, sf).groupBy("doc_id", "mode", "pos").agg(F.count_if(F.col("apos") >= 0).alias("n_args")))
query("x9_e2e_events", rsql("""SELECT doc_id, pos, apos, text, label, st AS start, en AS "end" FROM (SELECT sid, pos, -1 AS apos, text, type AS label, st, en FROM eg
    UNION ALL SELECT sid, o, apos, text, role, st, en FROM eargs) JOIN (SELECT sid, doc_id FROM src) USING (sid)""", "out", "runs", extra=E2E))(
    lambda spark, sf: flat_events(outputs(spark, sf).select("doc_id", X.serving_events(F.col("source"), F.col("e2e_text")).alias("evs")), "evs", "doc_id"))
query("x12_document_result", rsql("""SELECT doc_id, coalesce(a, 0) AS n_pipeline, coalesce(b, 0) AS n_e2e, coalesce(c, 0) AS n_merged, coalesce(d, 0) AS n_complete FROM src
    LEFT JOIN (SELECT sid, count(*) FILTER (WHERE mode = 'pipeline') AS a, count(*) FILTER (WHERE mode = 'e2e') AS b, count(*) FILTER (WHERE mode = 'merged') AS c FROM trig GROUP BY sid) USING (sid)
    LEFT JOIN (SELECT sid, count(*) AS d FROM eg GROUP BY sid) USING (sid)""", "out", "runs", extra=TRIG + ",\n  " + E2E))(
    lambda spark, sf: runs(spark, sf).select("doc_id", *[F.size(c).cast("long").alias(f"n_{n}") for c, n in (("pipeline", "pipeline"), ("e2e", "e2e"), ("merged", "merged"), ("complete_e2e", "complete"))]))

query("x13_review_preview", rsql("""SELECT doc_id, pos, apos, text, label FROM (
      SELECT sid, pos, -1 AS apos, text, type AS label FROM pick UNION ALL SELECT sid, o, apos, text, role FROM pargs2
      UNION ALL SELECT sid, pos, -1, text, type FROM eg WHERE sid NOT IN (SELECT sid FROM pick) UNION ALL SELECT sid, o, apos, text, role FROM eargs WHERE sid NOT IN (SELECT sid FROM pick))
    JOIN (SELECT sid, doc_id FROM src) USING (sid)""", "out", "ae", "runs", extra=TRIG + ",\n  " + E2E + """,
  pick AS MATERIALIZED (SELECT sid, pos, text, type, st, en FROM trig WHERE mode = 'merged' UNION ALL SELECT sid, pos, text, type, st, en FROM trig WHERE mode = 'pipeline' AND sid NOT IN (SELECT sid FROM tm)),
  """ + ae_items("items", "(SELECT * FROM ae WHERE mode = 'merged')") + """,
  panch AS (SELECT i.sid, i.mode, i.o, apos, i.text, role, t.st AS ts, t.en AS te FROM items i JOIN pick t ON t.sid = i.sid AND t.pos = i.o),
  """ + place("pargs2", "panch")))(
    lambda spark, sf: flat_events(X.review_preview(detected(spark, sf)).select("doc_id", "preview"), "preview", "doc_id").drop("start", "end"))

_C13 = TRIG + ",\n  " + ae_items("items", "(SELECT * FROM ae WHERE mode = 'pipeline')") + """,
  anchored AS (SELECT i.sid, i.mode, i.o, apos, i.text, role, t.st AS ts, t.en AS te FROM items i JOIN trig t ON t.sid = i.sid AND t.mode = i.mode AND t.pos = i.o),
  """ + place("args", "anchored") + """,
  lab AS (SELECT sid, st, en, 0 AS k, pos AS e, 0 AS a, 'E' || (pos + 1) || '-' || type AS label FROM trig WHERE mode = 'pipeline' AND st IS NOT NULL
    UNION ALL SELECT sid, st, en, 1, o, apos, 'E' || (o + 1) || '-Arg-' || role FROM args WHERE st IS NOT NULL),
  spots AS (SELECT sid, st, en, string_agg(label, ' ' ORDER BY k, e, a) AS label, CASE WHEN min(k) <> max(k) THEN 'both' WHEN min(k) = 0 THEN 'trigger' ELSE 'argument' END AS kind FROM lab GROUP BY sid, st, en),
  cut AS (SELECT *, lag(en + 1, 1, 0) OVER (PARTITION BY sid ORDER BY st, en) AS prev, row_number() OVER (PARTITION BY sid ORDER BY st, en) AS r FROM spots),
  seg AS (SELECT sid, r * 2 AS r, prev AS start, st AS stop, 'plain' AS kind, NULL AS label, false AS overlap FROM cut WHERE st > prev
    UNION ALL SELECT sid, r * 2 + 1, st, en + 1, kind, label, st < prev FROM cut
    UNION ALL SELECT src.sid, 1000000, coalesce(l, 0), length(plain), 'plain', NULL, false FROM src LEFT JOIN (SELECT sid, arg_max(en + 1, r) AS l FROM cut GROUP BY sid) USING (sid) WHERE coalesce(l, 0) < length(plain))"""
query("c13_segments", rsql("""SELECT doc_id, row_number() OVER (PARTITION BY sid ORDER BY r) - 1 AS seg_pos, start::BIGINT AS start, stop::BIGINT AS stop, kind, label, overlap,
    substring(plain, start + 1, stop - start) AS text FROM seg JOIN src USING (sid)""", "out", "ae", "runs", extra=_C13))(
    lambda spark, sf: runs(spark, sf).select("doc_id", F.posexplode(X.segments(F.col("source"), F.col("pipeline"))).alias("seg_pos", "x")).select(
        "doc_id", F.col("seg_pos").cast("long").alias("seg_pos"), F.col("x.start").cast("long").alias("start"), F.col("x.stop").cast("long").alias("stop"), "x.kind", "x.label", "x.overlap", "x.text"))

# ---- review --------------------------------------------------------------------------------------------
_BOTH = ae_items("items", "(SELECT * FROM ae WHERE mode = 'pipeline' UNION ALL SELECT * FROM aeref)") + """,
  anchored AS (SELECT *, NULL::BIGINT AS ts, NULL::BIGINT AS te FROM items),
  """ + place("args", "anchored") + f""",
  pr_ref AS MATERIALIZED (SELECT sid, mode, o, apos, {strip('text')} AS text, {strip('role')} AS role, st, en FROM args WHERE {strip('text')} <> '' AND {strip('role')} <> ''),
  fp AS MATERIALIZED (SELECT b.*, src.doc_id, src.dataset, src.src_id, row_number() OVER (PARTITION BY b.sid ORDER BY b.o, b.apos) - 1 AS local_idx FROM pr_ref b JOIN src USING (sid) WHERE mode = 'pipeline'
    AND NOT EXISTS (SELECT 1 FROM pr_ref r WHERE r.mode = 'ref' AND r.sid = b.sid AND r.text = b.text AND r.role = b.role))"""
_N = ("out", "ae", "aeref", "runs")
TASK = "argument_extraction_pipeline_pipeline"
_FPID = f"dataset || '-{TASK}-' || doc_id || '-' || local_idx"
_DEC = f""", dec AS (SELECT {_FPID.replace('doc_id', 'fp.doc_id')} AS fp_id, dataset, CASE quality WHEN 1 THEN 'true_positive_missing_gold' WHEN 0 THEN 'true_false_positive' ELSE 'uncertain' END AS decision, quality
    FROM fp LEFT JOIN labels ON labels.doc_id = fp.src_id WHERE local_idx % 4 <> 3)"""


def fps(spark, sf):
    return shared(spark, sf, "fp_records", lambda: review.fp_records(dealt(outputs(spark, sf)), "ae_pipeline", TASK, "base"))


def decisions(spark, sf):
    """A decision log from ``labels``: three of four records judged, some first judged ``uncertain``."""
    r = fps(spark, sf).where(F.col("local_idx") % 4 != 3).withColumn("src_id", F.shiftright(F.substring("doc_id", 5, 20).cast("long"), LINES.bit_length() - 1))
    j = r.join(table(spark, sf, "labels").select(F.col("doc_id").alias("src_id"), "quality"), "src_id", "left")
    final = F.when(F.col("quality") == 1, "true_positive_missing_gold").when(F.col("quality") == 0, "true_false_positive").otherwise("uncertain")
    rows = F.array(
        F.struct(F.lit("uncertain").alias("decision"), F.lit("first look").alias("notes"), F.lit(False).alias("schema_checked"), F.lit(1).alias("t")),
        F.struct(final.alias("decision"), F.lit("").alias("notes"), F.lit(True).alias("schema_checked"), F.lit(2).alias("t")))
    return j.select("fp_id", "dataset", "model_name", "doc_id", F.explode(rows).alias("x"), F.lit("r1").alias("reviewer")).select(
        "fp_id", "dataset", "model_name", "doc_id", "x.decision", "x.notes", "x.schema_checked", "reviewer", F.timestamp_seconds(F.lit(1704067200) + F.col("x.t")).alias("timestamp"))


query("e1_fp_records", sql(f"""SELECT {_FPID} AS fp_id, dataset, doc_id, text AS argument_text, role AS argument_role, st AS argument_start, en AS argument_end,
      {strip(f"regexp_extract(pred, '{_T19}([^:|]+)', 1)")} AS trigger_text, {strip(f"regexp_extract(pred, '{_T19}((?:[^:|]|:[^ |:])+)', 2)")} AS trigger_type, pred AS prediction_raw
    FROM fp JOIN ae USING (sid, mode, o)""", *_N, extra=_BOTH))(
    lambda spark, sf: review.fp_records(dealt(outputs(spark, sf)), "ae_pipeline", TASK, "base").select(
        "fp_id", "dataset", "doc_id", "argument_text", "argument_role", F.col("argument_start").cast("long").alias("argument_start"),
        F.col("argument_end").cast("long").alias("argument_end"), "trigger_text", "trigger_type", "prediction_raw"))
query("j9_fp_anti", sql("SELECT doc_id, o AS pred_pos, apos AS arg_pos, text, role FROM fp", *_N, extra=_BOTH))(
    lambda spark, sf: review.false_positives(dealt(outputs(spark, sf)), "ae_pipeline").select(
        "doc_id", F.col("pred_pos").cast("long").alias("pred_pos"), F.col("arg_pos").cast("long").alias("arg_pos"), "text", "role"))
query("w4_fp_id", sql(f"SELECT {_FPID} AS fp_id, local_idx, o AS pred_pos FROM fp", *_N, extra=_BOTH).replace(", o AS pred_pos FROM fp", " FROM fp"))(
    lambda spark, sf: fps(spark, sf).select("fp_id", F.col("local_idx").cast("long").alias("local_idx")))
query("e4_match_counts", sql("""SELECT dataset, count(*) FILTER (WHERE p AND r) AS tp, count(*) FILTER (WHERE p AND NOT r) AS fp, count(*) FILTER (WHERE r AND NOT p) AS fn FROM (
    SELECT dataset, sid, text, role, bool_or(mode = 'pipeline') AS p, bool_or(mode = 'ref') AS r FROM pr_ref JOIN (SELECT sid, dataset FROM src) USING (sid) GROUP BY ALL) GROUP BY dataset""", *_N, extra=_BOTH))(
    lambda spark, sf: review.match_counts(dealt(outputs(spark, sf)), "ae_pipeline").select("dataset", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), F.col("fn").cast("long").alias("fn")))
query("a10_fp_summary", sql("SELECT count(*) AS n, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets, 'base' AS models FROM fp", *_N, extra=_BOTH))(
    lambda spark, sf: review.fp_summary(fps(spark, sf)).select("n", F.array_join("datasets", ",").alias("datasets"), F.array_join("models", ",").alias("models")))
query("f7_wildcard_filter", sql(f"SELECT {_FPID} AS fp_id FROM fp WHERE dataset = 'geneva'", *_N, extra=_BOTH))(
    lambda spark, sf: review.filter_records(fps(spark, sf), "geneva", "__ALL__").select("fp_id"))
query("w3_latest_decision", sql("SELECT fp_id, decision, 1704067202::BIGINT AS decided FROM dec", *_N, extra=_BOTH + _DEC))(
    lambda spark, sf: review.latest_decisions(decisions(spark, sf)).select("fp_id", "decision", F.unix_timestamp("timestamp").alias("decided")))
query("j10_progress", sql("SELECT (SELECT count(*) FROM dec) AS reviewed, (SELECT count(*) FROM fp) AS total", *_N, extra=_BOTH + _DEC))(
    lambda spark, sf: review.progress(fps(spark, sf), decisions(spark, sf)))
query("j11_decisions", sql(f"SELECT {_FPID} AS fp_id, decision, '' AS notes, decision IS NOT NULL AS schema_checked FROM fp LEFT JOIN dec ON dec.fp_id = {_FPID.replace('dataset', 'fp.dataset').replace('doc_id', 'fp.doc_id')}".replace(
    f"SELECT {_FPID} AS fp_id", f"SELECT {_FPID.replace('dataset ', 'fp.dataset ').replace('doc_id', 'fp.doc_id')} AS fp_id"), *_N, extra=_BOTH + _DEC))(
    lambda spark, sf: review.attach_decisions(fps(spark, sf).select("fp_id"), decisions(spark, sf)).select("fp_id", "decision", "notes", "schema_checked"))
query("e3_review_state", sql("""SELECT dataset, decision, count(*) AS n FROM (SELECT fp.dataset, coalesce(decision, 'open') AS decision FROM fp LEFT JOIN dec ON dec.fp_id = """
                             + _FPID.replace("dataset ", "fp.dataset ").replace("doc_id", "fp.doc_id") + ") GROUP BY ALL", *_N, extra=_BOTH + _DEC))(
    lambda spark, sf: review.attach_decisions(fps(spark, sf).select("fp_id", "dataset"), decisions(spark, sf)).groupBy(
        "dataset", F.coalesce("decision", F.lit("open")).alias("decision")).agg(F.count("*").alias("n")))
query("a16_corrected_precision", sql("""SELECT dataset, predicted, coalesce(fps, 0) AS fps, coalesce(mg, 0) AS missing_gold, coalesce(un, 0) AS uncertain,
      round((predicted - coalesce(fps, 0)) / predicted, 6) AS precision, round((predicted - coalesce(fps, 0) + coalesce(mg, 0)) / predicted, 6) AS corrected_precision
    FROM (SELECT dataset, count(*) AS predicted FROM pr_ref JOIN (SELECT sid, dataset FROM src) USING (sid) WHERE mode = 'pipeline' GROUP BY ALL)
    LEFT JOIN (SELECT dataset, count(*) AS fps FROM fp GROUP BY ALL) USING (dataset)
    LEFT JOIN (SELECT dataset, count(*) FILTER (WHERE decision = 'true_positive_missing_gold') AS mg, count(*) FILTER (WHERE decision = 'uncertain') AS un FROM dec GROUP BY ALL) USING (dataset)""", *_N, extra=_BOTH + _DEC))(
    lambda spark, sf: review.corrected_precision(dealt(outputs(spark, sf)), "ae_pipeline", fps(spark, sf), decisions(spark, sf)))
