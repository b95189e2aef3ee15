"""Registered queries: insights over analysis runs, ingestion, prompts, scoring, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import prompts as P
from spanloom.functions import text as T
from spanloom.ontology import starter_ontology
from spanloom.operators import insights, parse, review, scoring
from spanloom.operators.lexicon import Lexicon, learn
from spanloom.plans.derived import LINES, corpus, outputs, runs, sentences, shared, table
from spanloom.plans.oracle import CTE, lit, rr, sql, strip, values, ws
from spanloom.plans.q_corpus import _WOVEN, _ae, expressive
from spanloom.plans.q_parse import ARGS, E2E, TRIG, W, fps, rsql, _BOTH, _N, _FPID
from spanloom.plans.registry import query
from spanloom.plans.standins import RuleClient, RuleScorer
from spanloom.session import fresh_path, materialise
from spanloom.sources import corpus as src
from spanloom.sources import documents as docs
from spanloom.sources import stored
from spanloom.streaming import jobs

ONTO = starter_ontology()
NAMES = ("out", "ae", "runs")
TYPES = ("Action", "Conflict:Attack", "Achieve", "conflict.attack.airstrikemissilestrike")
ROLES = ("Agent", "Place", "Target")
_T = ", ".join(lit(x) for x in TYPES)
_R = ", ".join(lit(x) for x in ROLES)
_STATE = """, key AS (SELECT sid, doc_id || '::' || dataset || '::' || mt || '::' || left(ww, 80) AS result_key, doc_id, dataset, mt AS model_type, plain FROM (
    SELECT *, CASE WHEN src_id % 3 = 0 THEN 'cross-domain' ELSE 'domain-specific' END AS mt, #ws AS ww FROM src))""".replace("#ws", ws("plain"))


def events(spark, sf):
    return insights.mode_events(runs(spark, sf))


# ---- counts ------------------------------------------------------------------------------------
query("a2_trigger_counts", rsql("""SELECT 'text' AS kind, text AS value, count(*) AS n FROM trig WHERE text <> '' GROUP BY ALL
    UNION ALL SELECT 'word', lower(text), count(*) FROM trig WHERE text <> '' GROUP BY ALL""", *NAMES, extra=TRIG))(lambda spark, sf: insights.trigger_counts(events(spark, sf)))
query("a3_type_counts", sql("SELECT dataset, etype AS type, count(*) AS n FROM ev WHERE valid GROUP BY ALL", "ev"))(
    lambda spark, sf: _a3(spark, sf))


def _a3(spark, sf):
    """Counts over the corpus: only positions and types are read, and partial counts precede the shuffle."""
    ev = corpus(spark, sf).select("dataset", F.size("tokens").alias("n_tokens"), F.explode("event_mentions").alias("e"))
    s, e = F.col("e.trigger.start").try_cast("int"), F.col("e.trigger.end").try_cast("int")
    return ev.where((s >= 0) & (e > s) & (s < F.col("n_tokens"))).groupBy("dataset", F.col("e.event_type").alias("type")).agg(F.count("*").alias("n"))


query("a3_mode_type_counts", rsql("SELECT type, count(*) AS n FROM trig WHERE type <> '' GROUP BY ALL", *NAMES, extra=TRIG))(lambda spark, sf: insights.type_counts(events(spark, sf)))
query("a4_role_counts", rsql("SELECT role, count(*) AS n FROM args WHERE role <> '' GROUP BY ALL", *NAMES, extra=ARGS))(lambda spark, sf: insights.role_counts(events(spark, sf)))
query("a5_argtext_counts", rsql("SELECT text, count(*) AS n FROM args WHERE text <> '' GROUP BY ALL", *NAMES, extra=ARGS))(lambda spark, sf: insights.argument_text_counts(events(spark, sf)))
query("a6_kpis", rsql("""SELECT (SELECT count(*) FROM src) AS documents, (SELECT count(*) FROM trig WHERE type <> '') AS events, (SELECT count(*) FROM args WHERE role <> '') AS roles,
    (SELECT count(DISTINCT lower(text)) FROM trig WHERE text <> '') AS trigger_words, (SELECT count(DISTINCT text) FROM args WHERE text <> '') AS argument_texts""", *NAMES, extra=ARGS))(
    lambda spark, sf: insights.kpis(runs(spark, sf)))
query("a7_coverage", sql("SELECT dataset, CASE WHEN src_id % 3 = 0 THEN 'cross-domain' ELSE 'domain-specific' END AS model_type, count(*) AS n FROM sent WHERE sid IN (SELECT sid FROM us) GROUP BY ALL", "sent", "us"))(
    lambda spark, sf: insights.coverage(runs(spark, sf)))
query("a8_doc_table", rsql("""SELECT result_key, doc_id, left(plain, 120) AS source_preview, coalesce(a, 0) AS pipeline_events, coalesce(b, 0) AS e2e_events, coalesce(c, 0) AS merged_events FROM key LEFT JOIN (
    SELECT sid, count(*) FILTER (WHERE mode = 'pipeline') AS a, count(*) FILTER (WHERE mode = 'e2e') AS b, count(*) FILTER (WHERE mode = 'merged') AS c FROM trig GROUP BY sid) USING (sid)""",
    *NAMES, extra=TRIG + _STATE))(lambda spark, sf: insights.documents_table(runs(spark, sf)).drop("dataset", "model_type", "analyzed_at"))
query("a9_options", rsql("SELECT DISTINCT 'type' AS kind, type AS value FROM trig WHERE type <> '' UNION SELECT DISTINCT 'role', role FROM args WHERE role <> ''", *NAMES, extra=ARGS))(
    lambda spark, sf: insights.filter_options(runs(spark, sf)))
query("f8_type_role_filter", rsql(f"""SELECT role, count(*) AS n FROM args a JOIN trig t ON t.sid = a.sid AND t.mode = a.mode AND t.pos = a.o WHERE t.type IN ({_T}) AND role IN ({_R}) GROUP BY ALL""", *NAMES, extra=ARGS))(
    lambda spark, sf: insights.role_counts(insights.filter_events(events(spark, sf), TYPES, ROLES)))
query("f9_doc_filter", rsql(f"""SELECT result_key, coalesce(a, 0) AS pipeline_events, coalesce(b, 0) AS e2e_events, coalesce(c, 0) AS merged_events FROM key LEFT JOIN (
    SELECT sid, count(*) FILTER (WHERE mode = 'pipeline') AS a, count(*) FILTER (WHERE mode = 'e2e') AS b, count(*) FILTER (WHERE mode = 'merged') AS c FROM trig t
    WHERE type IN ({_T}) AND EXISTS (SELECT 1 FROM args x WHERE x.sid = t.sid AND x.mode = t.mode AND x.o = t.pos AND role IN ({_R})) GROUP BY sid) USING (sid)""", *NAMES, extra=ARGS + _STATE))(
    lambda spark, sf: insights.documents_table(runs(spark, sf), TYPES, ROLES).select("result_key", "pipeline_events", "e2e_events", "merged_events"))
query("f10_run_select", rsql("SELECT 'hit' AS q, doc_id FROM key WHERE doc_id = (SELECT min(doc_id) FROM key) UNION ALL SELECT 'all', doc_id FROM key", *NAMES, extra=TRIG + _STATE))(lambda spark, sf: _f10(spark, sf))


def _f10(spark, sf):
    r = runs(spark, sf)
    first = r.agg(F.min_by("result_key", "doc_id")).first()[0]
    hit = insights.select_runs(r, [first]).select(F.lit("hit").alias("q"), "doc_id")
    return hit.unionByName(insights.select_runs(r, ["no such key"]).select(F.lit("all").alias("q"), "doc_id"))


query("f12_mode_unpivot", rsql("SELECT doc_id, mode, pos, text, type FROM trig JOIN (SELECT sid, doc_id FROM src) USING (sid)", *NAMES, extra=TRIG))(
    lambda spark, sf: events(spark, sf).select("doc_id", "mode", F.col("pos").cast("long").alias("pos"), "text", "type"))
query("w5_event_ordinal", rsql(f"""SELECT result_key, mode, 'E' || row_number() OVER (PARTITION BY sid, mode ORDER BY pos) AS ordinal, type, text, coalesce(k, 0) AS n_arguments
    FROM (SELECT * FROM trig WHERE type IN ({_T})) JOIN key USING (sid) LEFT JOIN (SELECT sid, mode, o AS pos, count(*) FILTER (WHERE role IN ({_R})) AS k FROM args GROUP BY ALL) USING (sid, mode, pos)""", *NAMES, extra=ARGS + _STATE))(
    lambda spark, sf: insights.event_cards(runs(spark, sf), TYPES, ROLES).drop("start", "end"))
query("o3_top15", rsql("""SELECT * FROM (SELECT 'top' AS q, text, count(*) AS n FROM args WHERE text <> '' GROUP BY ALL ORDER BY n DESC, text LIMIT 15)
    UNION ALL SELECT * FROM (SELECT 'first', text, n FROM (SELECT text, count(*) AS n, min(sid) AS f FROM args WHERE text <> '' GROUP BY ALL) ORDER BY f, text LIMIT 15)""", *NAMES, extra=ARGS))(
    lambda spark, sf: _o3(spark, sf))


def _o3(spark, sf):
    a = runs(spark, sf).select("sid", F.explode(F.array("pipeline", "e2e", "merged")).alias("evs")).select("sid", F.explode("evs").alias("e")).select(
        "sid", F.explode("e.arguments").alias("a")).select("sid", T.strip(F.col("a.text")).alias("text"))
    return insights.first_seen_top(a, "text", F.col("sid")).select(F.lit("top").alias("q"), "text", "n").unionByName(
        insights.first_seen_top(a, "text", F.col("sid"), compat=True).select(F.lit("first").alias("q"), "text", "n"))


query("w2_merge_runs", """SELECT result_key, arg_max(value, (b, ord)) AS value, min((b, ord)).b AS first_batch, min((b, ord)).ord AS first_ord FROM (
      SELECT 'u' || user_id || '::' || event_type || '::domain-specific::' || event_type AS result_key, value, {'b': CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END, 'ord': event_id} AS bo,
        CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS b, event_id AS ord FROM events) GROUP BY result_key""".replace("arg_max(value, (b, ord))", "arg_max(value, bo)").replace(
    "min((b, ord)).b", "min(bo).b").replace("min((b, ord)).ord", "min(bo).ord"))(lambda spark, sf: _w2(spark, sf))


def event_runs(spark, sf):
    """``events`` as runs: one per user and type, upserted again and again."""
    return table(spark, sf, "events").select(
        F.lit(None).cast("string").alias("result_key"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("doc_id"),
        F.col("event_type").alias("dataset"), F.lit("domain-specific").alias("model_type"), F.col("event_type").alias("source"), "value", F.col("event_id").alias("ord"))


def _w2(spark, sf):
    r = event_runs(spark, sf)
    return insights.upsert_runs(r.where(F.col("ord") % 2 == 0), r.where(F.col("ord") % 2 == 1)).select("result_key", "value", "first_batch", "first_ord")


# ---- requests ----------------------------------------------------------------------------------
_REQ = """SELECT doc_id AS n, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE '' END AS a, CASE WHEN doc_id % 3 = 0 THEN 'k' || doc_id END AS b, CASE WHEN doc_id % 4 = 0 THEN lang END AS ds,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS tx, CASE WHEN doc_id % 10 = 0 THEN source END AS co FROM documents"""


def requests(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "documents").select(
        i.alias("idx"), F.when(i % 2 == 0, i.cast("string")).otherwise("").alias("doc_id"), F.when(i % 3 == 0, F.concat(F.lit("k"), i.cast("string"))).alias("uid"),
        F.when(i % 4 == 0, F.col("lang")).alias("domain"), F.when(i % 5 == 0, "").otherwise(F.col("text")).alias("text"), F.when(i % 10 == 0, F.col("source")).alias("content"))


query("f13_alias", f"""SELECT n AS idx, coalesce(nullif(a, ''), nullif(b, ''), 'doc-' || (n + 1)) AS doc_id, coalesce(nullif(ds, ''), 'geneva') AS dataset, 'domain-specific' AS model_type,
    coalesce(nullif(tx, ''), nullif(co, ''), '') AS text FROM ({_REQ})""")(lambda spark, sf: insights.normalise_requests(requests(spark, sf)))
query("f14_empty_text", f"SELECT CASE WHEN coalesce(nullif(tx, ''), nullif(co, ''), '') = '' THEN 'rejected' ELSE 'ok' END AS status, count(*) AS n FROM ({_REQ}) GROUP BY ALL")(
    lambda spark, sf: _f14(spark, sf))


def _f14(spark, sf):
    good, bad = insights.split_empty(insights.normalise_requests(requests(spark, sf)))
    return good.select(F.lit("ok").alias("status")).unionByName(bad.select(F.lit("rejected").alias("status"))).groupBy("status").agg(F.count("*").alias("n"))


query("f11_has_results", "SELECT event_id, event_id % 3 = 0 AS done FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", insights.has_results(
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"parsed_detection": '), "props", F.lit("}"))).otherwise(F.col("props"))).alias("done")))
query("f16_max_docs", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 10")(
    lambda spark, sf: insights.max_docs(table(spark, sf, "documents").select("doc_id", "lang"), None, "doc_id"))

# ---- uploads -----------------------------------------------------------------------------------
_UP = """ul AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""


def uploads(spark, sf):
    """One upload per document: its lines as upload members, in the shapes the reader must accept."""
    i = F.col("doc_id")
    lines = F.split("text", "\n", -1)

    def member(x, p):
        return F.struct(
            F.when(p % 3 == 0, F.concat(F.lit("i"), p.cast("string"))).alias("id"),
            F.when(p % 3 != 2, F.concat(F.lit("d"), p.cast("string"))).alias("doc_id"),
            F.when((i % 7 != 3) | (p != 1), x).alias("text"))

    return table(spark, sf, "documents").select(
        i.cast("string").alias("upload"),
        F.when(i % 2 == 0, F.to_json(F.struct(F.transform(lines, member).alias("documents")))).otherwise(
            F.array_join(F.transform(lines, lambda x, p: F.to_json(member(x, p))), "\n")).alias("content"))


# An odd upload of one line is one JSON object without a list, which is refused.
_BADUP = "(doc_id % 7 = 3 AND n > 1) OR (doc_id % 2 = 1 AND n = 1)"
query("s4_ingest_strict", f"""WITH {_UP}, c AS (SELECT doc_id, count(*) AS n FROM ul GROUP BY doc_id)
    SELECT doc_id::VARCHAR AS upload, pos, CASE WHEN {_BADUP} THEN 'refused' WHEN pos % 3 = 0 THEN 'i' || pos WHEN pos % 3 = 1 THEN 'd' || pos ELSE 'doc_' || pos END AS id,
      CASE WHEN {_BADUP} THEN NULL ELSE line END AS text FROM ul JOIN c USING (doc_id) WHERE NOT ({_BADUP}) OR pos = 0""")(lambda spark, sf: _s4(spark, sf))


def _s4(spark, sf):
    good, bad = docs.strict(uploads(spark, sf))
    return good.select("upload", F.col("pos").cast("long").alias("pos"), "id", "text").unionByName(
        bad.select("upload", F.lit(0).cast("long").alias("pos"), F.lit("refused").alias("id"), F.lit(None).cast("string").alias("text")))


def shapes(spark, sf):
    """Each document as an upload in one of five shapes, by id."""
    i = F.col("doc_id")
    lines = F.split("text", "\n", -1)
    objs = F.transform(lines, lambda x, p: F.struct(F.concat(F.lit("n"), p.cast("string")).alias("uid"), x.alias("content")))
    pairs = F.map_from_entries(F.transform(lines, lambda x, p: F.struct(F.concat(F.lit("k"), F.lpad(((p * 7) % 101).cast("string"), 3, "0"), F.lit("_"), p.cast("string")), x)))
    return table(spark, sf, "documents").select(
        i.cast("string").alias("upload"),
        F.when(i % 5 == 0, F.to_json(lines)).when(i % 5 == 1, F.to_json(objs)).when(i % 5 == 2, F.to_json(F.struct(objs.alias("records"))))
        .when(i % 5 == 3, F.to_json(F.struct(F.col("text"), F.col("lang").alias("dataset")))).otherwise(F.to_json(pairs)).alias("content"))


query("s5_ingest_lenient", f"""WITH {_UP} SELECT upload, pos, doc_id, dataset, text FROM (
    SELECT doc_id::VARCHAR AS upload, pos, CASE doc_id % 5 WHEN 0 THEN 'doc-' || (pos + 1) WHEN 4 THEN 'k' || lpad(((pos * 7) % 101)::VARCHAR, 3, '0') || '_' || pos ELSE 'n' || pos END AS doc_id,
      'geneva' AS dataset, line AS text FROM ul WHERE doc_id % 5 <> 3
    UNION ALL SELECT doc_id::VARCHAR, 0, 'doc-1', lang, text FROM documents WHERE doc_id % 5 = 3)""")(
    lambda spark, sf: docs.normalised(docs.lenient(shapes(spark, sf))).select("upload", F.col("pos").cast("long").alias("pos"), "doc_id", "dataset", "text"))
query("s6_concat_json", f"WITH {_UP} SELECT doc_id::VARCHAR AS upload, pos, 'n' || pos AS doc_id, line AS text FROM ul")(lambda spark, sf: _s6(spark, sf))


def _s6(spark, sf):
    glued = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("upload"), F.concat(F.array_join(F.transform(
        F.split("text", "\n", -1), lambda x, p: F.to_json(F.struct(F.concat(F.lit("n"), p.cast("string")).alias("uid"), x.alias("content")))), " \n "), F.lit("\n")).alias("content"))
    return docs.normalised(docs.lenient(docs.concatenated(glued))).select("upload", F.col("pos").cast("long").alias("pos"), "doc_id", "text")


query("s7_fp_source", f"""WITH {_UP} SELECT doc_id::VARCHAR AS upload, pos, CASE WHEN pos % 2 = 0 THEN 'f' || pos ELSE 'fp-' || lpad(pos::VARCHAR, 7, '0') END AS fp_id, line AS source FROM ul WHERE doc_id % 3 <> 2
    UNION ALL SELECT doc_id::VARCHAR, -1, 'refused', NULL FROM documents WHERE doc_id % 3 = 2""")(lambda spark, sf: _s7(spark, sf))


def _s7(spark, sf):
    i = F.col("doc_id")
    objs = F.transform(F.split("text", "\n", -1), lambda x, p: F.struct(F.when(p % 2 == 0, F.concat(F.lit("f"), p.cast("string"))).alias("uid"), x.alias("sentence")))
    ups = table(spark, sf, "documents").select(i.cast("string").alias("upload"), F.when(i % 3 == 0, F.to_json(objs)).when(
        i % 3 == 1, F.to_json(F.struct(objs.alias("false_positives")))).otherwise(F.to_json(F.struct(F.col("text")))).alias("content"))
    good, bad = docs.fp_items(ups)
    cols = docs.fp_columns(good)
    # The upload and position travel next to the normalised record.
    recs = cols.select("upload", F.col("idx").cast("long").alias("pos"), F.struct("*").alias("r")).select(
        "upload", "pos", T.first_truthy(*[F.col(f"r.{a}") for a in review.ALIASES["fp_id"]], default=F.concat(F.lit("fp-"), F.lpad(F.col("pos").cast("string"), 7, "0"))).alias("fp_id"),
        T.first_truthy(*[F.col(f"r.{a}") for a in review.ALIASES["source"]], default=F.lit("")).alias("source"))
    return recs.unionByName(bad.select("upload", F.lit(-1).cast("long").alias("pos"), F.lit("refused").alias("fp_id"), F.lit(None).cast("string").alias("source")))


query("e2_fp_normalise", """SELECT CASE WHEN event_id % 2 = 0 THEN 'x' || event_id ELSE 'fp-' || lpad(event_id::VARCHAR, 7, '0') END AS fp_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'unknown' END AS dataset,
    'unknown' AS model_name, user_id::VARCHAR AS doc_id, props AS source, '' AS trigger_text, event_type AS trigger_type, '' AS argument_text, coalesce(CASE WHEN event_id % 5 = 0 THEN 'r' END, '') AS argument_role FROM events""")(
    lambda spark, sf: review.normalise_records(table(spark, sf, "events").select(
        F.col("event_id").alias("idx"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).alias("id"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("ds_key"), F.col("user_id").alias("document_id"), F.col("props").alias("text"),
        F.lit("").alias("trigger_type"), "event_type", F.when(F.col("event_id") % 5 == 0, "r").alias("role"))))


# ---- sinks -------------------------------------------------------------------------------------
@query("s8_result_source", rsql("SELECT doc_id, count(*) AS n_refs FROM aeref JOIN (SELECT sid, doc_id FROM src) USING (sid) GROUP BY ALL", "out", "aeref"))
def s8(spark, sf):
    """S11 then S8: written and read back with the result schema."""
    path = fresh_path(spark, "results")
    src.write_results(_items(spark, sf), path)
    return src.read_results(spark, path, array=False).select("doc_id", F.size("argument_extraction_pipeline_pipeline.references").cast("long").alias("n_refs")).where(F.col("n_refs") > 0)


def _items(spark, sf):
    o = outputs(spark, sf)
    return o.select("doc_id", "source", F.struct(F.col("ti").alias("prediction")).alias("trigger_identification"),
                    F.struct(F.col("tc_pipeline").alias("prediction")).alias("trigger_classification_pipeline"),
                    F.struct(F.col("ae_refs").alias("references"), F.col("ae_pipeline").alias("predictions")).alias("argument_extraction_pipeline_pipeline"))


@query("s11_result_sink", rsql("SELECT doc_id, tc_pipeline AS prediction FROM out", "out"))
def s11(spark, sf):
    path = fresh_path(spark, "results")
    src.write_results(_items(spark, sf), path)
    return src.read_results(spark, path, array=False).select("doc_id", F.col("trigger_classification_pipeline.prediction").alias("prediction"))


@query("s9_generations_sink", rsql("""SELECT e.epoch, dataset, count(*) AS n, sum(length(tc_pipeline))::BIGINT AS chars FROM out, (VALUES (1), (2)) e(epoch) GROUP BY ALL""", "out"))
def s9(spark, sf):
    path = fresh_path(spark, "generations")
    g = outputs(spark, sf).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("epoch"), "dataset", "doc_id", "split", F.lit("trigger_classification_pipeline").alias("task"),
                                  F.col("sid").alias("index"), "source", F.lit("").alias("reference"), F.col("tc_pipeline").alias("prediction"))
    src.write_generations(g, path)
    src.write_generations(g.where(F.col("epoch") == 2), path)      # a re-run replaces its partitions
    return src.read_generations(spark, path).groupBy("epoch", "dataset").agg(F.count("*").alias("n"), F.sum(F.length("prediction")).alias("chars"))


@query("s13_decision_sink", sql(f"SELECT count(*) AS n, count(DISTINCT dataset) AS datasets, 'Re_Viewer' AS reviewer FROM fp", *_N, extra=_BOTH))
def s13(spark, sf):
    path = fresh_path(spark, "decisions")
    d = fps(spark, sf).select("fp_id", "dataset", "model_name", "doc_id", F.lit("uncertain").alias("decision"), F.lit("").alias("notes"), F.lit(False).alias("schema_checked"),
                              F.lit(" Re Viewer ").alias("reviewer"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"))
    src.append_decisions(d, path)
    return src.read_decisions(spark, path).groupBy("reviewer").agg(F.count("*").alias("n"), F.countDistinct("dataset").alias("datasets"))


@query("s12_annotated_doc", rsql("""SELECT src_id::VARCHAR AS doc_id, dataset, coalesce(a, 0) AS n_pipeline, coalesce(b, 0) AS n_e2e, coalesce(c, 0) AS n_merged FROM (
      SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY src_id, dataset ORDER BY sid DESC) = 1) LEFT JOIN (
    SELECT sid, count(*) FILTER (WHERE mode = 'pipeline') AS a, count(*) FILTER (WHERE mode = 'e2e') AS b, count(*) FILTER (WHERE mode = 'merged') AS c FROM trig GROUP BY sid) USING (sid)""", *NAMES, extra=TRIG))
def s12(spark, sf):
    """Every sentence's run is a save under its source document, in three rounds by line; the last one per data set stays."""
    r = runs(spark, sf)

    def result(col):
        return F.struct("doc_id", "source", parse.export_events(F.col(col)).alias("events"))

    saves = r.select(F.col("src_id").cast("string").alias("doc_id"), F.lit("text").alias("source"), "dataset", F.col("sid").alias("save_ord"),
                     F.struct(*[result(m).alias(m) for m in ("pipeline", "e2e", "merged")]).alias("modes"), parse.export_events(F.col("complete_e2e")).alias("complete"))
    path, line = fresh_path(spark, "annotated"), F.col("save_ord") % LINES
    for when in (line == 0, line == 1, line > 1):
        stored.save_documents(saves.where(when), path, buckets=16)
    return stored.read(spark, path).select("doc_id", F.explode("events").alias("dataset", "x")).select(
        "doc_id", "dataset", *[F.coalesce(F.size(parse.import_events(F.col(f"x.{m}.events"))), F.lit(0)).cast("long").alias(f"n_{m}") for m in ("pipeline", "e2e", "merged")])


# ---- assembly ----------------------------------------------------------------------------------
@query("j7_assemble_refs", sql("""SELECT doc_id, coalesce(o, '') AS tc_e2e_reference, coalesce(c, 0) AS n_refs FROM (SELECT DISTINCT sid, doc_id FROM sp)
    LEFT JOIN (SELECT sid, string_agg('trigger> ' || txt || '>=' || ptype, ' | ' ORDER BY j) AS o FROM sp GROUP BY sid) USING (sid) LEFT JOIN (SELECT sid, count(*) AS c FROM aeok GROUP BY sid) USING (sid)""", "sp", "aeok"))
def j7(spark, sf):
    from spanloom.operators.assemble import assemble_references
    return assemble_references(expressive(spark, sf)).select("doc_id", "tc_e2e_reference", F.size("ae_references").cast("long").alias("n_refs"))


# ---- prompts and replies --------------------------------------------------------------------------
query("p1_prompts", rsql("""SELECT doc_id, 'Domain: ' || dataset || '. Identify trigger words. ' || plain AS p1, CASE WHEN tc_pipeline = '' THEN '' ELSE 'Domain: ' || dataset || '. Classify trigger types. ' || tc_pipeline END AS p2,
    'Domain: ' || dataset || '. Classify trigger types end-to-end. ' || plain AS p3, 'domain: ' || dataset || '. Event trigger and argument extraction. ' || plain AS p4 FROM out""", "out"))(
    lambda spark, sf: outputs(spark, sf).select("doc_id", P.identification_prompt(F.col("dataset"), F.col("source")).alias("p1"), P.classification_prompt(F.col("dataset"), F.col("tc_pipeline")).alias("p2"),
                                                P.direct_classification_prompt(F.col("dataset"), F.col("source")).alias("p3"), P.e2e_prompt(F.col("dataset"), F.col("source")).alias("p4")))
query("p5_extraction_prompts", rsql("""SELECT doc_id, mode, pos, 'Domain: ' || dataset || '. Extract arguments for a specific event. argument> ' || coalesce(roles, '') || ' for trigger> ' || text || '>=' || type || ': ' || plain AS input
    FROM trig JOIN src USING (sid) LEFT JOIN (SELECT dataset AS ds, event_type, string_agg(role, ' | ' ORDER BY role_ord) AS roles FROM dim_roles GROUP BY ALL) d ON d.ds = dataset AND d.event_type = type""", *NAMES, "dim_roles", extra=TRIG))(
    lambda spark, sf: P.extraction_prompts(_mode_triggers(spark, sf), ONTO).select("doc_id", "mode", F.col("pos").cast("long").alias("pos"), "input"))


def _mode_triggers(spark, sf):
    by = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("evs")) for m in ("pipeline", "e2e", "merged")])).alias("x")
    return runs(spark, sf).select("dataset", "doc_id", "source", by).select("dataset", "doc_id", "source", "x.mode", F.posexplode("x.evs").alias("pos", "e")).select(
        "dataset", "doc_id", "source", "mode", "pos", F.col("e.trigger.text").alias("text"), F.col("e.trigger.type").alias("type"))


_LAB = """el AS (SELECT dataset, string_agg(event_type, ', ' ORDER BY event_type) AS el FROM (SELECT DISTINCT dataset, event_type FROM dim_types) GROUP BY dataset),
  rl AS (SELECT dataset, string_agg(role, ', ' ORDER BY o) AS rl FROM (SELECT dataset, role, min(type_ord * 1000 + role_ord) AS o FROM dim_roles WHERE role IS NOT NULL GROUP BY ALL) GROUP BY dataset)"""


def _msg(kind, lines):
    body = " || chr(10) || ".join(lines + [lit(x) for x in P.TASK[kind]] + [lit(P.JSON_RULE)])
    return f"'[SYSTEM]' || chr(10) || {lit(P.SYSTEM[kind])} || chr(10) || chr(10) || '[USER]' || chr(10) || {body} || chr(10) || chr(10) || 'Text:' || chr(10) || plain || chr(10) || chr(10) || '[ASSISTANT]' || chr(10)"


query("p6_stage1_messages", sql(f"""SELECT doc_id, {_msg('stage1', ["'Dataset: ' || dataset", "'Allowed event labels: [' || el || ']'", "'Allowed entity labels: [' || rl || ']'"])} AS prompt
    FROM sent JOIN el USING (dataset) JOIN rl USING (dataset)""", "sent", "dim_types", "dim_roles", extra=_LAB))(
    lambda spark, sf: P.stage1_messages(corpus(spark, sf).select("doc_id", "dataset", T.detokenise(F.col("tokens")).alias("text")), ONTO).select("doc_id", P.render_chat(F.col("messages")).alias("prompt")))
query("p7_stage2_messages", sql(f"""SELECT doc_id, {_msg('stage2', ["'You are now identifying exact text spans.'", "'Proposed event labels: [' || dataset || ', x]'", "'Proposed entity labels: []'"])} AS prompt FROM sent""", "sent"))(
    lambda spark, sf: corpus(spark, sf).select("doc_id", P.render_chat(P.stage2_messages(
        T.detokenise(F.col("tokens")), F.array(F.col("dataset"), F.lit(" x "), F.col("dataset"), F.lit("")), F.array().cast("array<string>"))).alias("prompt")))
query("p8_pos_dep_messages", sql(f"SELECT doc_id, {_msg('pos', [])} AS pos_prompt, {_msg('dep', [])} AS dep_prompt FROM sent", "sent"))(
    lambda spark, sf: corpus(spark, sf).withColumn("text", T.detokenise(F.col("tokens"))).select(
        "doc_id", P.render_chat(P.pos_messages(F.col("text"))).alias("pos_prompt"), P.render_chat(P.dep_messages(F.col("text"))).alias("dep_prompt")))
query("p9_render_chat", "SELECT conv_id, string_agg('[' || upper(role) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || '[ASSISTANT]' || chr(10) AS prompt FROM conversations GROUP BY conv_id")(
    lambda spark, sf: table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m")).select(
        "conv_id", P.render_chat(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("prompt")))
query("o5_label_caps", sql("""SELECT dataset, labels, count(*) AS n FROM sent JOIN (SELECT dataset, string_agg(event_type, ',' ORDER BY event_type) AS labels FROM (
    SELECT DISTINCT dataset, event_type FROM dim_types QUALIFY dense_rank() OVER (PARTITION BY dataset ORDER BY event_type) <= 3) GROUP BY dataset) USING (dataset) GROUP BY ALL""", "sent", "dim_types"))(
    lambda spark, sf: corpus(spark, sf).groupBy("dataset").agg(F.count("*").alias("n")).join(P.schema_labels(ONTO, spark, max_events=3), "dataset").select(
        "dataset", F.array_join("event_labels", ",").alias("labels"), "n"))


def replies(spark, sf):
    """Chat replies around the JSON each event carries: fenced, bare, or without any."""
    i = F.col("event_id")
    body = F.concat(F.lit('{"event labels": ["'), "event_type", F.lit('", " '), "event_type", F.lit(' ", "", "z"], "triggers": [["'), "event_type", F.lit('", "T"], ["x"], ["a", " "], ["b", "c", "d"]], "p": '), "props", F.lit("}"))
    return table(spark, sf, "events").select("event_id", F.when(i % 4 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone {x}"))).when(
        i % 4 == 1, F.concat(F.lit("Here "), body, F.lit(" ok"))).when(i % 4 == 2, F.lit("none")).otherwise(body).alias("reply"))


_BODY = """'{"event labels": ["' || event_type || '", " ' || event_type || ' ", "", "z"], "triggers": [["' || event_type || '", "T"], ["x"], ["a", " "], ["b", "c", "d"]], "p": ' || props || '}'"""
query("t20_extract_json", f"SELECT event_id, CASE WHEN event_id % 4 = 2 THEN NULL ELSE {_BODY} END AS json FROM events")(
    lambda spark, sf: replies(spark, sf).select("event_id", T.extract_json(F.col("reply")).alias("json")))
query("t21_norm_pairs", "SELECT event_id, CASE WHEN event_id % 4 = 2 THEN '' ELSE event_type || '=T|b=c' END AS pairs FROM events")(
    lambda spark, sf: replies(spark, sf).select("event_id", F.array_join(F.transform(T.normalise_tuples(F.get_json_object(T.extract_json(F.col("reply")), "$.triggers")), lambda p: F.array_join(p, "=")), "|").alias("pairs")))
query("t22_norm_labels", "SELECT event_id, CASE WHEN event_id % 4 = 2 THEN '' WHEN event_type = 'z' THEN 'z' ELSE event_type || '|z' END AS labels FROM events")(
    lambda spark, sf: replies(spark, sf).select("event_id", F.array_join(T.normalise_labels(F.get_json_object(T.extract_json(F.col("reply")), "$['event labels']")), "|").alias("labels")))


# ---- scoring -----------------------------------------------------------------------------------
def docs_to_score(spark, sf):
    return corpus(spark, sf).select("dataset", F.when(F.col("src_id") % 3 == 0, "cross-domain").otherwise("domain-specific").alias("model_type"), "doc_id", T.detokenise(F.col("tokens")).alias("source"), "src_id")


_LEX = r"""tw AS (SELECT ev.*, n_args IS NOT NULL AS whole FROM ev LEFT JOIN nargs USING (sid, pos) WHERE valid AND split = 'train'),
  wn AS (SELECT dataset, txt AS word, etype, count(*) AS n, count(*) FILTER (whole) AS m FROM tw WHERE regexp_full_match(txt, '\p{L}+') GROUP BY ALL),
  lexw AS (SELECT dataset, word, max({'n': n, 't': etype}) AS x FROM wn GROUP BY ALL), lexe AS (SELECT dataset, word, max({'n': m, 't': etype}) AS x FROM wn WHERE m > 0 GROUP BY ALL),
  an AS (SELECT a.dataset, a.etype, a.txt AS word, a.role, count(*) AS n FROM arg a JOIN tw USING (sid, pos) WHERE regexp_full_match(a.txt, '\p{L}+') GROUP BY ALL),
  lexa AS (SELECT dataset, etype, word, max({'n': n, 'r': role}).r AS role FROM an GROUP BY ALL),
  pieces AS MATERIALIZED (SELECT sid, doc_id, dataset, unnest(ps) AS word, generate_subscripts(ps, 1) AS p FROM (SELECT *, regexp_extract_all(plain, '\p{L}+|[^\p{L}]+') AS ps FROM sent))"""


def lexicon(spark, sf):
    """What the training split of the derived corpus teaches."""
    return Lexicon(shared(spark, sf, "lexicon", lambda: learn(corpus(spark, sf)).table))


@query("i1_batch_score", sql("""SELECT doc_id, string_agg(CASE WHEN x IS NULL THEN word ELSE 'trigger> ' || word || '>' END, '' ORDER BY p) AS prediction
    FROM pieces LEFT JOIN lexw USING (dataset, word) GROUP BY doc_id""", "sent", "ev", "nargs", "arg", extra=_LEX))
def i1(spark, sf):
    p = docs_to_score(spark, sf).select("doc_id", F.col("dataset").alias("model_key"), P.identification_prompt(F.col("dataset"), F.col("source")).alias("input"))
    return scoring.batch_score(p, lexicon(spark, sf)).select("doc_id", "prediction")


class Fragile(RuleScorer):
    """Fails on prompts that hold a vertical bar."""

    def score(self, texts):
        if any("|" in t for t in texts):
            raise ValueError("bar")
        return super().score(texts)


@query("i4_error_rows", sql("SELECT CASE WHEN contains(plain, '|') THEN 'ValueError: bar' ELSE 'ok' END AS status, count(*) AS n FROM sent GROUP BY ALL", "sent"))
def i4(spark, sf):
    p = docs_to_score(spark, sf).select("doc_id", F.col("dataset").alias("model_key"), P.identification_prompt(F.col("dataset"), F.col("source")).alias("input"))
    good, bad = scoring.split_errors(scoring.batch_score(p, Fragile))
    return good.select(F.lit("ok").alias("status")).unionByName(bad.select(F.col("error").alias("status"))).groupBy("status").agg(F.count("*").alias("n"))


_SWEEP = r""", lexan AS (SELECT dataset, etype, word, max({'n': n, 'r': role}) AS x FROM an GROUP BY ALL), ep(epoch) AS (VALUES (1), (2)),
  kw AS MATERIALIZED (SELECT sid, p, word, x.t AS t, x.n AS n FROM pieces JOIN lexw USING (dataset, word)),
  ke AS MATERIALIZED (SELECT sid, p, word, x.t AS t, x.n AS n FROM pieces JOIN lexe USING (dataset, word)),
  kt AS (SELECT sid, p, word, x.t AS t, x.n AS n FROM (SELECT sid, dataset, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM (
    SELECT sid, dataset, regexp_extract_all(tagged, 'trigger> (\p{L}+)>', 1) AS ws FROM woven JOIN sent USING (sid))) JOIN lexw USING (dataset, word)),
  kr AS MATERIALIZED (SELECT sid, etype, p, word, x.r AS r, x.n AS n FROM (SELECT sid, dataset, word, min(p) AS p FROM pieces GROUP BY ALL) JOIN lexan USING (dataset, word)),
  tails AS MATERIALIZED (SELECT sid, epoch, etype, string_agg('argument>' || word || '>=' || r, ' | ' ORDER BY p) AS a1, string_agg('argument> ' || word || '>=' || r, ' | ' ORDER BY p) AS a4
    FROM kr, ep WHERE n >= epoch GROUP BY ALL),
  pred AS (SELECT sid, epoch, 'trigger_identification' AS task, string_agg(CASE WHEN x.n >= epoch THEN 'trigger> ' || word || '>' ELSE word END, '' ORDER BY p) AS said
      FROM pieces LEFT JOIN lexw USING (dataset, word), ep GROUP BY ALL
    UNION ALL SELECT sid, epoch, 'trigger_classification_pipeline', string_agg(word || '=' || t, ' | ' ORDER BY p) FROM kt, ep WHERE n >= epoch GROUP BY sid, epoch
    UNION ALL SELECT sid, epoch, 'trigger_classification_e2e', string_agg('trigger> ' || word || '>=' || t, ' | ' ORDER BY p) FROM ke, ep WHERE n >= epoch GROUP BY sid, epoch
    UNION ALL SELECT sid, epoch, 'trigger_identification_augument', string_agg(word, ' | ' ORDER BY p) FROM kw, ep WHERE n >= epoch GROUP BY sid, epoch
    UNION ALL SELECT sid, epoch, 'argument_identification_e2e', string_agg('argument>' || word || '>=' || r || '(' || etype || ')', ' | ' ORDER BY p, etype) FROM kr, ep WHERE n >= epoch GROUP BY sid, epoch
    UNION ALL SELECT sid, epoch, 'event_extraction_e2e', string_agg('trigger>' || word || '>=' || t || coalesce(' | ' || a1, ''), ' || ' ORDER BY p)
      FROM (SELECT * FROM ke, ep WHERE n >= epoch) LEFT JOIN (SELECT sid, epoch, etype AS t, a1 FROM tails) USING (sid, epoch, t) GROUP BY sid, epoch),
  ins AS (SELECT sid, 'trigger_identification' AS task, 'Domain: ' || dataset || '. Identify trigger words. ' || plain AS source FROM sent WHERE sid IN (SELECT sid FROM sp)
    UNION ALL SELECT sid, 'trigger_classification_pipeline', 'Domain: ' || dataset || '. Classify trigger types. ' || tagged FROM sent JOIN woven USING (sid)
    UNION ALL SELECT sid, 'trigger_classification_e2e', 'Domain: ' || dataset || '. Classify trigger types end-to-end. ' || plain FROM sent WHERE sid IN (SELECT sid FROM sp)
    UNION ALL SELECT sid, 'trigger_identification_augument', 'domain: ' || dataset || '. trigger words: ' || plain FROM sent WHERE sid IN (SELECT sid FROM sp)
    UNION ALL SELECT sid, 'argument_identification_e2e', 'Domain: ' || dataset || '. Identify potential arguments. ' || plain FROM sent
      WHERE sid IN (SELECT sid FROM aeok) AND sid IN (SELECT sid FROM evargs)
    UNION ALL SELECT sid, 'event_extraction_e2e', 'Domain: ' || dataset || '. Event trigger and argument extraction. ' || plain FROM sent WHERE sid IN (SELECT sid FROM sp))"""


@query("i2_sweep", sql("""SELECT epoch, doc_id, split, task, 0::BIGINT AS index, source, coalesce(said, '') AS prediction
      FROM ins CROSS JOIN ep JOIN (SELECT sid, doc_id, split FROM sent) USING (sid) LEFT JOIN pred USING (sid, epoch, task)
    UNION ALL SELECT epoch, a.doc_id, a.split, 'argument_extraction_pipeline', a.pos,
      'Domain: ' || a.dataset || '. Extract arguments for a specific event. argument> ' || asked || ' for trigger> ' || a.txt || '>=' || a.etype || ': ' || plain,
      'trigger> ' || a.txt || '>=' || a.etype || ': ' || coalesce(a4, '')
      FROM aeok a JOIN filled USING (sid, pos) JOIN (SELECT sid, plain FROM sent) USING (sid) CROSS JOIN ep LEFT JOIN tails USING (sid, epoch, etype)""",
    "sent", "sp", "aeok", "evargs", "nargs", "arg", "dim_roles", extra=_LEX + ", " + _WOVEN + ", " + _ae() + _SWEEP))
def i2(spark, sf):
    """Every instance of every task; the model of epoch 2 knows words seen twice."""
    return scoring.sweep(expressive(spark, sf), [1, 2], lexicon(spark, sf)).select("epoch", "doc_id", "split", "task", "index", "source", "prediction")


_EVENTS = """string_agg(word || '=' || x.t || coalesce('(' || args || ')', ''), ' ' ORDER BY p)"""


@query("i3_chain", sql(f"""SELECT doc_id, coalesce(a, '') AS pipeline, coalesce(b, '') AS e2e, coalesce(c, '') AS complete_e2e, '' AS failed FROM sent LEFT JOIN (
      SELECT sid, {_EVENTS} AS a FROM pieces JOIN lexw USING (dataset, word) LEFT JOIN found ON found.s = sid AND found.etype = x.t GROUP BY sid) USING (sid)
    LEFT JOIN (SELECT sid, {_EVENTS} AS b FROM pieces JOIN lexe USING (dataset, word) LEFT JOIN found ON found.s = sid AND found.etype = x.t GROUP BY sid) USING (sid)
    LEFT JOIN (SELECT sid, {_EVENTS} AS c FROM pieces JOIN lexe USING (dataset, word) LEFT JOIN found ON found.s = sid AND found.etype = x.t GROUP BY sid) USING (sid)""",
    "sent", "ev", "nargs", "arg", extra=_LEX + """, found AS (SELECT sid AS s, etype, string_agg(word || '=' || role, ',' ORDER BY p) AS args FROM (
      SELECT sid, dataset, word, min(p) AS p FROM pieces GROUP BY ALL) JOIN lexa USING (dataset, word) GROUP BY ALL)"""))
def i3(spark, sf):
    """Triggers with types and arguments with roles, of every mode whose triggers do not hang on offsets."""
    out = scoring.chain(docs_to_score(spark, sf), ONTO, lexicon(spark, sf))

    def shown(events):
        args = lambda e: F.array_join(F.transform(e["arguments"], lambda a: F.concat(a["text"], F.lit("="), a["role"])), ",")
        return F.array_join(F.transform(events, lambda e: F.concat(e["trigger"]["text"], F.lit("="), e["trigger"]["type"], F.when(F.size(e["arguments"]) > 0, F.concat(
            F.lit("("), args(e), F.lit(")"))).otherwise(""))), " ")

    return out.select("doc_id", *[shown(F.col(c)).alias(c) for c in ("pipeline", "e2e", "complete_e2e")], "failed")


@query("i5_two_stage", sql(f"""SELECT doc_id, el AS event_labels, replace(replace(string_split(plain, ' ')[1], '\\', ''), '"', '') AS word, false AS failed FROM sent JOIN (
    SELECT dataset, min(event_type) AS el FROM dim_types GROUP BY dataset) USING (dataset)""", "sent", "dim_types"))
def i5(spark, sf):
    d = docs_to_score(spark, sf).select("doc_id", "dataset", F.col("source").alias("text"))
    out = scoring.two_stage(d, ONTO, RuleClient, pos=True)
    return out.select("doc_id", F.array_join("event_labels", ",").alias("event_labels"), F.coalesce(F.get(F.get("triggers", F.lit(0)), F.lit(0)), F.lit("")).alias("word"), "failed")


_RUN_KEY = f"coalesce(nullif(doc_id, ''), 'doc-1') || '::' || dataset || '::' || model_type || '::' || left({ws('text')}, 80)"


@query("i6_infer_runs", sql(rf"""SELECT status, doc_id, dataset, model_type, CASE WHEN status = 'kept' AND src_id % 8 = 0 THEN 'own-' || doc_id ELSE {_RUN_KEY} END AS result_key,
      CASE status WHEN 'scored' THEN len(regexp_extract_all(plain, '\p{{L}}{{9,}}')) END AS n_events, CASE WHEN status = 'kept' THEN '2024-01-01' END AS day
    FROM (SELECT *, CASE WHEN src_id % 7 = 0 THEN '' ELSE plain END AS text, CASE WHEN src_id % 7 = 0 THEN 'empty' WHEN src_id % 4 = 0 THEN 'kept' ELSE 'scored' END AS status,
      CASE WHEN src_id % 3 = 0 THEN 'cross-domain' ELSE 'domain-specific' END AS model_type
      FROM (SELECT * REPLACE (CASE WHEN src_id % 11 = 0 THEN 'geneva' ELSE dataset END AS dataset) FROM sent))""", "sent"))
def i6(spark, sf):
    """Records without text, with results of their own, and to be scored; every eleventh names no data set."""
    s = F.col("src_id")
    own = F.when(s % 8 == 0, F.concat(F.lit(', "result_key": "own-'), "doc_id", F.lit('"'))).otherwise("")
    records = docs_to_score(spark, sf).withColumn(
        "raw", F.when(s % 4 == 0, F.concat(F.lit('{"parsed_detection": {}, "analyzed_at": "2024-01-01T00:00:00"'), own, F.lit("}"))).otherwise("{}")).withColumn(
        "text", F.when(s % 7 != 0, F.col("source"))).withColumn("dataset", F.when(s % 11 != 0, F.col("dataset")))
    runs = scoring.infer_runs(records, ONTO, RuleScorer)
    return runs.select("status", "doc_id", "dataset", "model_type", "result_key", F.when(F.col("status") == "scored", F.size("pipeline")).alias("n_events"),
                       F.when(F.col("status") == "kept", F.date_format("analyzed_at", "yyyy-MM-dd")).alias("day"))


# ---- streaming ---------------------------------------------------------------------------------
def _stream(spark, sf, name, df):
    """The rows as files a stream reads, a few per trigger."""
    path = fresh_path(spark, f"{name}-in")
    df.repartition(4).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("r1_stream_score", sql(f"""SELECT doc_id, dataset, model_type, CASE WHEN src_id % 5 = 0 THEN 'rejected' ELSE 'scored' END AS status,
      CASE WHEN src_id % 5 <> 0 THEN {_RUN_KEY} END AS result_key, CASE WHEN src_id % 5 <> 0 THEN coalesce(triggers, '') END AS triggers
    FROM (SELECT *, plain AS text, CASE WHEN src_id % 3 = 0 THEN 'cross-domain' ELSE 'domain-specific' END AS model_type FROM sent)
    LEFT JOIN (SELECT sid, string_agg(word || '=' || x.t, ' ' ORDER BY p) AS triggers FROM pieces JOIN lexw USING (dataset, word) GROUP BY sid) USING (sid)""", "sent", "ev", "nargs", "arg", extra=_LEX))
def r1(spark, sf):
    """Requests under their aliases; every fifth has no text."""
    d = docs_to_score(spark, sf).select(F.col("doc_id").alias("id"), F.when(F.col("src_id") % 5 != 0, F.col("source")).alias("text"), F.col("dataset").alias("domain"), "model_type")
    out, rejects, ck = (fresh_path(spark, n) for n in ("r1-out", "r1-rejects", "r1-ck"))
    jobs.score_documents(_stream(spark, sf, "r1", d), ONTO, lexicon(spark, sf), out, rejects, ck).awaitTermination()
    ids = ["doc_id", "dataset", "model_type"]
    found = F.array_join(F.transform("pipeline", lambda e: F.concat(e["trigger"]["text"], F.lit("="), e["trigger"]["type"])), " ")
    scored = spark.read.parquet(out).select(*ids, F.lit("scored").alias("status"), "result_key", found.alias("triggers"))
    return scored.unionByName(spark.read.parquet(rejects).select(*ids, F.lit("rejected").alias("status")), allowMissingColumns=True)


def _stream_in_order(spark, name, df, batch, n, per_file=None):
    """The rows as ``n`` batches of files that arrive one after the other: those of which ``batch`` gives 0 come first.

    A batch is one file, or with ``per_file`` (for jobs that do not mind the order within a batch) as many as the smallest batch
    fills with so many rows, so that no task writes a whole batch.
    """
    path = fresh_path(spark, f"{name}-in")
    df = materialise(df.withColumn("_batch", batch), f"{name}-rows")
    files = 1
    if per_file:
        sizes = [r["count"] for r in df.groupBy("_batch").count().collect()]
        files = max(1, min(sizes) // per_file) if len(sizes) == n else 1
    for i in range(n):
        rows = df.where(F.col("_batch") == i).drop("_batch")
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("_batch").schema).option("maxFilesPerTrigger", files).parquet(path)


@query("r2_stream_upsert", """SELECT result_key, arg_max(value, event_id) AS value, max(event_id) AS ord, min(event_id) AS first_ord FROM (
    SELECT *, 'u' || user_id || '::' || event_type AS result_key FROM events) GROUP BY ALL""")
def r2(spark, sf):
    """Runs arrive in three batches that have nothing to do with their order."""
    d = event_runs(spark, sf).withColumn("result_key", F.concat_ws("::", "doc_id", "dataset"))
    out, ck = fresh_path(spark, "r2-out"), fresh_path(spark, "r2-ck")
    jobs.upsert_state(_stream_in_order(spark, "r2", d, F.pmod(F.col("ord") * 7, F.lit(3)), 3, per_file=200_000), out, ck, buckets=16).awaitTermination()
    return stored.read(spark, out).select("result_key", "value", "ord", "first_ord")


_DAY = "'u' || user_id || '::' || strftime(ts, '%Y-%m-%d')"


@query("r2_stream_first", f"""SELECT result_key, min(m).event_id AS ord, min(m).value AS value FROM (
    SELECT {_DAY} AS result_key, {{'ts': ts, 'event_id': event_id, 'value': value}} AS m FROM events) GROUP BY ALL""")
def r2_first(spark, sf):
    """The first run of each user and day; days arrive in order, a third of all days at a time."""
    e = table(spark, sf, "events").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    d = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("::"), F.date_format("ts", "yyyy-MM-dd")).alias("result_key"), F.col("event_id").alias("ord"), "value", "ts")
    span = e.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).first()
    days = F.datediff(F.to_date("ts"), F.lit(span.a))
    out, ck = fresh_path(spark, "r2f-out"), fresh_path(spark, "r2f-ck")
    jobs.first_runs(_stream_in_order(spark, "r2f", d, F.floor(days * 3 / ((span.b - span.a).days + 1)), 3), out, ck).awaitTermination()
    return spark.read.parquet(out).select("result_key", "ord", "value")


# Thirds of the time come one after the other, every tenth event two batches late.  A batch leaves out what the batch before it has closed, by the
# watermark of the batches before that one.
_ARRIVAL = "least(floor(epoch(ts - lo) * 3 / (epoch(hi - lo) + 1)), 2) + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END"


@query("r3_window_counts", f"""WITH e AS (SELECT event_id, event_type, ts, date_trunc('hour', ts) AS w, {_ARRIVAL} AS b FROM events, (SELECT min(ts) AS lo, max(ts) AS hi FROM events)),
  m AS (SELECT b, max(ts) AS hi FROM e GROUP BY b), mark AS (SELECT x.b, max(m.hi) - INTERVAL 2 HOUR AS mark FROM e x JOIN m ON m.b < x.b - 1 GROUP BY x.b),
  j AS (SELECT e.*, coalesce(w + INTERVAL 1 HOUR <= date_trunc('millisecond', mark), false) AS late FROM e LEFT JOIN mark USING (b)),
  fin AS (SELECT date_trunc('millisecond', max(ts) - INTERVAL 2 HOUR) AS mark FROM events)
  SELECT CASE WHEN late THEN 'dropped' WHEN w + INTERVAL 1 HOUR <= fin.mark THEN 'closed' ELSE 'open' END AS state, CASE WHEN NOT late THEN strftime(w, '%Y-%m-%d %H:%M:%S') END AS window_start,
    CASE WHEN NOT late THEN event_type END AS event_type, count(*) AS n FROM j, fin GROUP BY ALL""")
def r3(spark, sf):
    """Hourly counts under a watermark of two hours; a tenth of the events comes two batches late."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    span = e.agg(F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("b")).first()
    third = F.least(F.floor((F.unix_micros("ts") - span.a) * 3 / (span.b - span.a + 1_000_000)), F.lit(2))
    arrival = third + F.when(F.col("event_id") % 10 == 0, 2).otherwise(0)
    out, ck = fresh_path(spark, "r3-out"), fresh_path(spark, "r3-ck")
    q = jobs.window_counts(_stream_in_order(spark, "r3", e, arrival, 5), out, ck, watermark="2 hours")
    q.awaitTermination()

    def shown(df, state):
        return df.select(F.lit(state).alias("state"), F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")

    late = spark.range(1).select(F.lit("dropped").alias("state"), F.lit(jobs.dropped_rows(spark, q, out, ck)).cast("long").alias("n")).where("n > 0")
    return shown(spark.read.parquet(out), "closed").unionByName(shown(jobs.open_windows(spark, ck), "open")).unionByName(late, allowMissingColumns=True)
