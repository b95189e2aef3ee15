"""Registered queries over the derived corpus: sources, filters, joins, windows, instances."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import assemble, harmonise, instances, spans
from spanloom.ontology import starter_ontology
from spanloom.plans.derived import corpus, dealt, shared, table
from spanloom.plans.oracle import clean, lit, spaced, sql, strip, values, ws
from spanloom.plans.registry import query
from spanloom.session import fresh_path
from spanloom.sources import corpus as src

ONTO = starter_ontology()


def mentions(spark, sf):
    """Flat events ``dataset, split, doc_id, pos, event_type``."""
    return corpus(spark, sf).select("dataset", "split", "doc_id", "sid", F.posexplode("event_mentions").alias("pos", "e")).select(
        "dataset", "split", "doc_id", "sid", F.col("pos").cast("long").alias("pos"), "e")


def expressive(spark, sf):
    """All default instances, written once as the training table the assembly queries read."""
    return shared(spark, sf, "instances", lambda: instances.build_expressive(dealt(corpus(spark, sf)), ONTO))


# ---- S -----------------------------------------------------------------------------------------
@query("s1_corpus_scan", sql("""SELECT dataset, split, count(*) AS docs, sum(n)::BIGINT AS tokens, sum(coalesce(c, 0))::BIGINT AS events
    FROM sent LEFT JOIN (SELECT sid, count(*) AS c FROM ev GROUP BY sid) USING (sid) GROUP BY ALL""", "sent", "ev"))
def s1(spark, sf):
    root = fresh_path(spark, "corpus-json")
    src.write_corpus(corpus(spark, sf), root)
    df = src.read_corpus(spark, root, ["geneva", "m2e2", "rams", "wikievents", "casie"])
    return df.groupBy("dataset", "split").agg(
        F.count("*").alias("docs"), F.sum(F.size("tokens")).alias("tokens"),
        F.sum(F.coalesce(F.size("event_mentions"), F.lit(0)).cast("long")).alias("events"))


@query("s2_doc_ids", sql("""SELECT sid, dataset, split, dataset || '_' || split || '_' || (row_number() OVER (PARTITION BY dataset, split ORDER BY sid) - 1) AS doc_id
    FROM sent""", "sent"))
def s2(spark, sf):
    return assemble.doc_ids(corpus(spark, sf).select("sid", "dataset", "split"), combined=True).select("sid", "dataset", "split", "doc_id")


@query("s3_head_per_split", sql("""SELECT dataset, split, sid, n::BIGINT AS n_tokens FROM sent
    QUALIFY row_number() OVER (PARTITION BY dataset, split ORDER BY sid) <= 100""", "sent"))
def s3(spark, sf):
    return assemble.head_per_split(corpus(spark, sf), 100).select("dataset", "split", "sid", F.size("tokens").cast("long").alias("n_tokens"))


@query("s10_task_sink", sql("""SELECT 'trigger_identification' AS task, split, count(DISTINCT sid) AS n FROM sp GROUP BY ALL
    UNION ALL SELECT 'argument_extraction_pipeline', split, count(*) FROM aeok GROUP BY ALL""", "sp", "aeok"))
def s10(spark, sf):
    path = fresh_path(spark, "tasks")
    src.write_tasks(expressive(spark, sf), path)
    df = assemble.drop_null_pairs(src.read_tasks(spark, path))
    return instances.task_select(df, ["trigger_identification", "argument_extraction_pipeline"]).groupBy("task", "split").agg(F.count("*").alias("n"))


@query("s14_dims", sql("""SELECT dataset, count(*) AS n_events, count(type_ord) AS n_known, count(DISTINCT etype) AS n_types
    FROM ev LEFT JOIN dim_types d USING (dataset) WHERE d.event_type = ev.etype GROUP BY dataset""", "ev", "dim_types"))
def s14(spark, sf):
    ev = mentions(spark, sf).select("dataset", F.col("e.event_type").alias("event_type"))
    return harmonise.dims_used(ev, ONTO)


# ---- F -----------------------------------------------------------------------------------------
@query("f1_valid_spans", sql("SELECT dataset, split, doc_id, pos, s::BIGINT AS s, e::BIGINT AS e, txt AS text, etype AS type FROM ev WHERE valid", "ev"))
def f1(spark, sf):
    return spans.valid_spans(corpus(spark, sf)).select(
        "dataset", "split", "doc_id", F.col("pos").cast("long").alias("pos"), F.col("s").cast("long").alias("s"),
        F.col("e").cast("long").alias("e"), "text", "type")


@query("f2_drop_no_trigger", sql("SELECT doc_id, count(*) AS n_spans FROM sp GROUP BY doc_id", "sp"))
def f2(spark, sf):
    return spans.drop_no_trigger(corpus(spark, sf)).select("doc_id", F.size("spans").cast("long").alias("n_spans"))


@query("f3_ae_eligible", sql("SELECT doc_id, pos, n_args FROM aeok JOIN nargs USING (sid, pos)", "aeok", "nargs"))
def f3(spark, sf):
    return spans.ae_eligible(spans.enrich(corpus(spark, sf))).select(
        "doc_id", F.col("ev.pos").cast("long").alias("pos"), F.col("ev.n_args").cast("long").alias("n_args"))


@query("f4_quarantine", f"""WITH t AS (SELECT doc_id, line_no, {spaced('line')} AS line FROM (
      SELECT doc_id, unnest(string_split(text, '.')) AS line, generate_subscripts(string_split(text, '.'), 1) - 1 AS line_no FROM documents))
    SELECT CASE WHEN line = '' THEN 'no tokens' ELSE 'ok' END AS reason, count(*) AS n FROM t GROUP BY ALL""")
def f4(spark, sf):
    tokens = F.transform(F.split("text", r"\.", -1), lambda x: F.split(T.space_punct(x), " "))
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(tokens).alias("line_no", "tokens")).withColumn(
        "tokens", F.filter("tokens", lambda t: t != ""))
    good, bad = spans.quarantine(lines)
    return good.select(F.lit("ok").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("f6_null_pairs", sql("SELECT dataset, count(*) AS n FROM ev WHERE id IS NOT NULL AND txt <> '' GROUP BY dataset", "ev"))
def f6(spark, sf):
    ev = spans.enrich(corpus(spark, sf)).select("dataset", F.explode("mentions").alias("m"))
    pairs = ev.select("dataset", F.col("m.id").alias("input"), T.truthy(F.col("m.text")).alias("output"))
    return assemble.drop_null_pairs(pairs).groupBy("dataset").agg(F.count("*").alias("n"))


@query("f15_task_select", sql("""SELECT dataset, split, 'event_extraction_e2e' AS task, count(DISTINCT sid) AS n FROM sp GROUP BY ALL
    UNION ALL SELECT dataset, split, 'argument_identification_e2e', count(DISTINCT sid) FROM aeok JOIN arg a USING (sid)
    WHERE a.txt <> '' GROUP BY aeok.dataset, aeok.split""".replace("SELECT dataset, split, 'argument", "SELECT aeok.dataset, aeok.split, 'argument"), "sp", "aeok", "arg"))
def f15(spark, sf):
    return instances.task_select(expressive(spark, sf), ["event_extraction_e2e", "argument_identification_e2e"]).groupBy(
        "dataset", "split", "task").agg(F.count("*").alias("n"))


# ---- J -----------------------------------------------------------------------------------------
@query("j1_type_remap", sql("""SELECT doc_id, pos, ev.etype AS event_type, coalesce(d.unified_type, ev.etype) AS new_type, d.unified_type IS NOT NULL AS mapped
    FROM ev LEFT JOIN dim_map d ON d.dataset = ev.dataset AND d.original_type = ev.etype""", "ev", "dim_map"))
def j1(spark, sf):
    ev = mentions(spark, sf).withColumn("event_type", F.col("e.event_type"))
    return harmonise.remap_types(ev, ONTO).select("doc_id", "pos", "event_type", "new_type", "mapped")


@query("j2_role_remap", sql("""SELECT a.doc_id, a.pos, row_number() OVER (PARTITION BY a.sid, a.pos ORDER BY a.k) - 1 AS apos, a.role,
      coalesce(x.unified_role, y.unified_role, a.role) AS new_role
    FROM arg a LEFT JOIN dim_role_map x ON x.dataset = a.dataset AND x.original_type = a.etype AND x.original_role = a.role
    LEFT JOIN (SELECT dataset, original_type, lower(original_role) AS low, arg_min(unified_role, ord) AS unified_role FROM dim_role_map GROUP BY ALL) y
      ON y.dataset = a.dataset AND y.original_type = a.etype AND y.low = lower(a.role)""", "arg", "dim_role_map"))
def j2(spark, sf):
    args = mentions(spark, sf).select("dataset", "doc_id", "pos", F.col("e.event_type").alias("event_type"), F.posexplode("e.arguments").alias("apos", "a"))
    args = args.withColumn("role", F.coalesce("a.role", "a.role_type", "a.label"))
    return harmonise.remap_roles(args, ONTO).select("doc_id", "pos", F.col("apos").cast("long").alias("apos"), "role", "new_role")


_VARIED = "CASE pos % 3 WHEN 1 THEN upper(etype) WHEN 2 THEN etype || '_x' ELSE etype END"


def _varied(c):
    return F.when(F.col("pos") % 3 == 1, F.upper(c)).when(F.col("pos") % 3 == 2, F.concat(c, F.lit("_x"))).otherwise(c)


@query("j3_roles_for_type", sql(f"""SELECT ev.doc_id, ev.pos, {_VARIED} AS event_type,
      CASE WHEN pos % 3 = 2 THEN coalesce(seen, '') ELSE roles END AS roles
    FROM ev LEFT JOIN (SELECT dataset, event_type, string_agg(role, ' | ' ORDER BY role_ord) AS roles FROM dim_roles GROUP BY ALL) d
      ON d.dataset = ev.dataset AND d.event_type = ev.etype
    LEFT JOIN (SELECT sid, pos, string_agg(role, ' | ' ORDER BY k) AS seen FROM arg GROUP BY ALL) s USING (sid, pos)""", "ev", "arg", "dim_roles"))
def j3(spark, sf):
    ev = mentions(spark, sf).withColumn("event_type", _varied(F.col("e.event_type")))
    seen = F.transform("e.arguments", lambda a: F.coalesce(spans.arg_role(a), F.lit("Unknown")))
    return harmonise.roles_for_type(ev, ONTO, "dataset", F.col("event_type"), seen).select(
        "doc_id", "pos", "event_type", F.array_join("roles", " | ").alias("roles"))


@query("j4_display_tag", sql("""SELECT doc_id, pos, event_type, coalesce(
      (SELECT tag FROM dim_tags t WHERE t.dataset = v.ds AND t.event_type = v.event_type),
      (SELECT tag FROM dim_tags t WHERE t.dataset = v.ds AND t.event_type = lower(v.event_type)),
      (SELECT tag FROM dim_tags t WHERE t.dataset = v.ds AND t.event_type = upper(v.event_type)),
      (SELECT tag FROM dim_tags t WHERE t.dataset = v.ds AND t.event_type = translate(v.event_type, ':/-', '___')),
      (SELECT arg_min(tag, ds_ord) FROM dim_tags t WHERE t.event_type = v.event_type), v.event_type) AS tag
    FROM (SELECT doc_id, pos, CASE WHEN pos % 4 = 3 THEN 'casie' ELSE dataset END AS ds,
      CASE pos % 3 WHEN 1 THEN upper(etype) WHEN 2 THEN etype || '_x' ELSE etype END AS event_type FROM ev) v""", "ev", "dim_tags"))
def j4(spark, sf):
    ev = mentions(spark, sf).withColumn("event_type", _varied(F.col("e.event_type"))).withColumn(
        "dataset", F.when(F.col("pos") % 4 == 3, "casie").otherwise(F.col("dataset")))
    return harmonise.tag_types(ev, ONTO).select("doc_id", "pos", "event_type", "tag")


@query("j5_entity_lookup", sql("""SELECT doc_id, pos, row_number() OVER (PARTITION BY sid, pos ORDER BY k) - 1 AS apos, txt AS text
    FROM arg WHERE style = 2""", "arg"))
def j5(spark, sf):
    c = corpus(spark, sf).select("doc_id", "tokens", "entity_mentions", F.posexplode("event_mentions").alias("pos", "e"))
    a = c.select("doc_id", "tokens", "entity_mentions", F.col("pos").cast("long").alias("pos"),
                 F.posexplode(F.filter("e.arguments", lambda a: a["entity_id"].isNotNull())).alias("apos", "a"))
    return a.select("doc_id", "pos", F.col("apos").cast("long").alias("apos"),
                    spans.entity_text(F.col("tokens"), F.col("entity_mentions"), F.col("a.entity_id")).alias("text"))


@query("j6_primary_type", sql("""SELECT doc_id, j, s::BIGINT AS s, e::BIGINT AS e, ptype AS type, coalesce(ctype, 'Unknown') AS compat_type
    FROM sp LEFT JOIN (SELECT sid, s AS s2, raw_e AS e2, arg_min(etype, pos) AS ctype FROM ev GROUP BY ALL) c ON c.sid = sp.sid AND c.s2 = sp.s AND c.e2 = sp.e""", "sp").replace("SELECT doc_id, j", "SELECT sp.doc_id, j"))
def j6(spark, sf):
    en = spans.enrich(corpus(spark, sf))
    both = F.transform("spans", lambda x: F.struct(
        x["s"].cast("long").alias("s"), x["e"].cast("long").alias("e"),
        spans.primary_type(F.col("spans"), F.col("mentions"), x).alias("type"),
        spans.primary_type(F.col("spans"), F.col("mentions"), x, compat=True).alias("compat_type")))
    return en.select("doc_id", F.posexplode(both).alias("j", "x")).select("doc_id", F.col("j").cast("long").alias("j"), "x.*")


@query("j14_type_hierarchy", sql("""SELECT type_group, secondary_type, coalesce(unified_type, etype) AS new_type, count(*) AS n FROM ev
    LEFT JOIN dim_map d ON d.dataset = ev.dataset AND d.original_type = ev.etype LEFT JOIN dim_unified USING (unified_type) GROUP BY ALL""", "ev", "dim_map", "dim_unified"))
def j14(spark, sf):
    ev = mentions(spark, sf).select("dataset", F.col("e.event_type").alias("event_type"))
    return harmonise.type_hierarchy(ev, ONTO).groupBy("type_group", "secondary_type", "new_type").agg(F.count("*").alias("n"))


_MODELS = [("geneva", "/models/geneva"), ("m2e2", "/models/m2e2"), ("cross-domain", "/models/all")]


@query("j13_route_model", sql(f"""SELECT model_key, coalesce(model_path, 'none') AS model_path, count(*) AS n FROM (
      SELECT CASE WHEN src_id % 3 = 0 THEN 'cross-domain' ELSE dataset END AS model_key FROM sent) LEFT JOIN {values(_MODELS)} m(model_key, model_path) USING (model_key) GROUP BY ALL""", "sent"))
def j13(spark, sf):
    from spanloom.ontology import local_frame
    req = corpus(spark, sf).select("dataset", F.when(F.col("src_id") % 3 == 0, "cross-domain").otherwise("domain-specific").alias("model_type"))
    good, bad = harmonise.route_models(req, local_frame(spark, _MODELS, "model_key string, model_path string"))
    return good.select("model_key", "model_path").unionByName(bad.select("model_key", F.lit("none").alias("model_path"))).groupBy(
        "model_key", "model_path").agg(F.count("*").alias("n"))


# ---- A -----------------------------------------------------------------------------------------
_COMB = "dataset IN ('m2e2', 'rams', 'wikievents')"


def combined(spark, sf):
    return corpus(spark, sf).where(F.col("dataset").isin("m2e2", "rams", "wikievents"))


@query("a1_remap_stats", sql(f"""SELECT dataset, sum(mapped)::BIGINT AS mapped, sum(unmapped)::BIGINT AS unmapped, count(*) AS items FROM (
      SELECT s.dataset, s.sid, coalesce(nm, 0) AS mapped, coalesce(nu, 0) AS unmapped FROM sent s LEFT JOIN (
        SELECT sid, count(d.unified_type) AS nm, count(*) - count(d.unified_type) AS nu FROM ev LEFT JOIN dim_map d ON d.dataset = ev.dataset AND d.original_type = ev.etype
        GROUP BY sid) USING (sid) WHERE s.{_COMB}) GROUP BY ROLLUP (dataset)""", "sent", "ev", "dim_map"))
def a1(spark, sf):
    return harmonise.remap_stats(harmonise.remap_corpus(combined(spark, sf), ONTO))


@query("a11_instance_counts", sql("""SELECT dataset, t.task, split, count(DISTINCT sid) AS n FROM sp, (VALUES ('trigger_identification'), ('trigger_identification_augument'),
      ('trigger_classification_pipeline'), ('trigger_classification_e2e'), ('event_extraction_e2e')) t(task) GROUP BY ALL
    UNION ALL SELECT dataset, 'argument_extraction_pipeline', split, count(*) FROM aeok GROUP BY ALL
    UNION ALL SELECT aeok.dataset, 'argument_identification_e2e', aeok.split, count(DISTINCT sid) FROM aeok JOIN arg a USING (sid) WHERE a.txt <> '' GROUP BY ALL""",
    "sp", "aeok", "arg"))
def a11(spark, sf):
    return instances.instance_counts(expressive(spark, sf))


@query("a14_collect_refs", sql("""SELECT doc_id, string_agg('trigger> ' || txt || '>=' || etype, ' || ' ORDER BY pos) AS refs, count(*) AS n FROM aeok GROUP BY doc_id""", "aeok"))
def a14(spark, sf):
    refs = assemble.ae_references(expressive(spark, sf))
    heads = F.transform("ae_refs", lambda r: F.regexp_extract(r, r"(?s)^(trigger> .*?>=.*?): (?:None=|argument> |$)", 1))
    return refs.select("doc_id", F.array_join(heads, " || ").alias("refs"), F.size("ae_refs").cast("long").alias("n"))


@query("a15_schema_tree", sql("""SELECT d.dataset, n_types, d.event_type, roles, n_roles, coalesce(n_events, 0) AS n_events
    FROM (SELECT dataset, event_type, string_agg(role, ' | ' ORDER BY role_ord) AS roles, count(role) AS n_roles FROM dim_roles GROUP BY ALL) d
    JOIN (SELECT dataset, count(*) AS n_types FROM dim_types GROUP BY ALL) USING (dataset)
    LEFT JOIN (SELECT dataset, etype AS event_type, count(*) AS n_events FROM ev GROUP BY ALL) USING (dataset, event_type)""", "ev", "dim_roles", "dim_types"))
def a15(spark, sf):
    return harmonise.schema_tree(mentions(spark, sf).select("dataset", F.col("e.event_type").alias("event_type")), ONTO)


# ---- W / O / U -----------------------------------------------------------------------------------
@query("w1_span_dedupe", sql("SELECT doc_id, p, s::BIGINT AS s, e::BIGINT AS e, pos, etype AS type FROM us", "us"))
def w1(spark, sf):
    en = spans.enrich(corpus(spark, sf))
    return en.select("doc_id", F.posexplode("uspans").alias("p", "x")).select(
        "doc_id", F.col("p").cast("long").alias("p"), F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e"),
        F.col("x.pos").cast("long").alias("pos"), "x.type")


@query("w6_trigger_index", sql("""SELECT a.doc_id, a.pos, CASE WHEN u.p IS NOT NULL THEN u.p + 1 ELSE nu + r END AS k
    FROM (SELECT *, CASE WHEN raw_e > n THEN dense_rank() OVER (PARTITION BY sid, raw_e > n ORDER BY s) END AS r FROM aeok) a
    LEFT JOIN us u ON u.sid = a.sid AND u.s = a.s AND u.e = a.raw_e LEFT JOIN (SELECT sid, count(*) AS nu FROM us GROUP BY sid) c ON c.sid = a.sid""", "aeok", "us"))
def w6(spark, sf):
    en = spans.enrich(corpus(spark, sf))
    eligible = F.filter("mentions", lambda x: x["valid"] & (x["n_args"] > 0))
    ranks = T.let(instances.trigger_places(F.col("mentions"), F.col("uspans")), lambda places: F.transform(eligible, lambda m: F.struct(
        m["pos"].cast("long").alias("pos"), instances.trigger_index(places, m).cast("long").alias("k"))))
    return en.select("doc_id", F.explode(ranks).alias("x")).select("doc_id", "x.*")


@query("w10_prefix_fraction", sql("""SELECT dataset, split, doc_id, pos FROM (
      SELECT dataset, split, doc_id, pos, row_number() OVER w AS r, count(*) OVER (PARTITION BY dataset, split) AS c FROM ev WINDOW w AS (PARTITION BY dataset, split ORDER BY sid, pos))
    WHERE r <= floor(c * 0.25::DOUBLE)""", "ev"))
def w10(spark, sf):
    return assemble.prefix_fraction(mentions(spark, sf), 0.25, "sid", ("dataset", "split"), ("pos",)).select("dataset", "split", "doc_id", "pos")


@query("w11_navigation", sql("""SELECT dataset, doc_id, r AS cursor, greatest(r - 1, 0) AS previous, least(r + 1, c - 1) AS next FROM (
      SELECT dataset, doc_id, row_number() OVER (PARTITION BY dataset ORDER BY sid) - 1 AS r, count(*) OVER (PARTITION BY dataset) AS c FROM sent)""", "sent"))
def w11(spark, sf):
    from spanloom.operators.review import navigation
    return navigation(corpus(spark, sf).select("dataset", "doc_id", "sid"), ["dataset"], "sid").select(
        "dataset", "doc_id", "cursor", "previous", "next")


@query("o1_sorted_spans", sql("SELECT doc_id, string_agg(s || '-' || e, ' ' ORDER BY j) AS spans FROM sp GROUP BY doc_id", "sp"))
def o1(spark, sf):
    en = spans.drop_no_trigger(corpus(spark, sf))
    return en.select("doc_id", F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), " ").alias("spans"))


@query("u1_concat", sql("""SELECT source, task, count(*) AS n FROM (
      SELECT 'expressive' AS source, 'trigger_identification' AS task FROM sp GROUP BY sid
      UNION ALL SELECT 'plain', 'trigger_identification' FROM sp GROUP BY sid
      UNION ALL SELECT 'expressive', 'argument_extraction_pipeline' FROM aeok UNION ALL SELECT 'plain', 'argument_extraction' FROM aeok) GROUP BY ALL""", "sp", "aeok"))
def u1(spark, sf):
    a = expressive(spark, sf).withColumn("source", F.lit("expressive"))
    b = instances.build_plain(corpus(spark, sf), ONTO).withColumn("source", F.lit("plain"))
    df = assemble.concat_instances(a, b)
    return df.where(F.col("task").isin("trigger_identification", "argument_extraction_pipeline", "argument_extraction")).groupBy(
        "source", "task").agg(F.count("*").alias("n"))


@query("u4_amount_compat", sql("""SELECT dataset, split, (count(*) + floor(count(*) * 0.1::DOUBLE))::BIGINT AS n FROM ev GROUP BY ALL""", "ev"))
def u4(spark, sf):
    ev = mentions(spark, sf).select("dataset", "split", "sid", "pos")
    both = assemble.amount_compat(ev, 0.1, "sid", ("dataset", "split"), ("pos",))
    return both.groupBy("dataset", "split").agg(F.count("*").alias("n"))


@query("u6_ordered_distinct", sql("""SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS words FROM (
      SELECT doc_id, t, min(i) AS i FROM (SELECT doc_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM sent) GROUP BY ALL) GROUP BY doc_id""", "sent"))
def u6(spark, sf):
    return corpus(spark, sf).select("doc_id", F.array_join(T.ordered_distinct(F.col("tokens")), " ").alias("words"))


# ---- G -----------------------------------------------------------------------------------------
_WOVEN = f"""woven AS (SELECT sid, {clean("body || ' ' || array_to_string(tokens[last_e + 1:], ' ')")} AS tagged FROM (
    SELECT sid, string_agg(array_to_string(tokens[prev_e + 1:s], ' ') || ' trigger> ' || txt || '>', ' ' ORDER BY j) AS body, max_by(e, j) AS last_e
    FROM sp JOIN (SELECT sid, tokens FROM sent) USING (sid) GROUP BY sid) JOIN (SELECT sid, tokens FROM sent) USING (sid))"""


def _g(task, domain=None, build=instances.build_expressive, cols=("dataset", "split", "doc_id", "input", "output"), **kw):
    def run(spark, sf):
        df = build(corpus(spark, sf), ONTO, **kw)
        return df.where(F.col("task") == task).select(*cols)
    return run


def _expr(task):
    return lambda spark, sf: instances.build_expressive(corpus(spark, sf), ONTO, tasks=[task]).select("dataset", "split", "doc_id", "input", "output")


query("g1_ti", sql("""SELECT dataset, split, doc_id, 'Domain: ' || dataset || '. Identify trigger words. ' || plain AS input, tagged AS output
    FROM woven JOIN sent USING (sid)""", "sp", extra=_WOVEN))(_expr("trigger_identification"))

query("g2_tc_tagged", sql("""SELECT dataset, split, doc_id, 'Domain: ' || dataset || '. Classify trigger types. ' || tagged AS input, o AS output FROM sent JOIN woven USING (sid)
    JOIN (SELECT sid, string_agg(txt || '=' || ptype, ' | ' ORDER BY j) AS o FROM sp GROUP BY sid) USING (sid)""", "sp", extra=_WOVEN))(_expr("trigger_classification_pipeline"))

query("g3_tc_e2e", sql("""SELECT dataset, split, doc_id, 'Domain: ' || dataset || '. Classify trigger types end-to-end. ' || plain AS input, o AS output FROM sent
    JOIN (SELECT sid, string_agg('trigger> ' || txt || '>=' || ptype, ' | ' ORDER BY j) AS o FROM sp GROUP BY sid) USING (sid)""", "sp"))(_expr("trigger_classification_e2e"))

query("g4_ti_aug", sql("""SELECT dataset, split, doc_id, 'domain: ' || dataset || '. trigger words: ' || plain AS input, o AS output FROM sent
    JOIN (SELECT sid, string_agg(txt, ' | ' ORDER BY j) AS o FROM sp GROUP BY sid) USING (sid)""", "sp"))(_expr("trigger_identification_augument"))

_E2E = """(SELECT sid, string_agg('trigger>' || txt || '>=' || etype || coalesce('{i}' || {a}, ''), '{o}' ORDER BY p) AS o
      FROM us LEFT JOIN evargs USING (sid, pos) GROUP BY sid)"""
query("g5_e2e", sql(f"""SELECT dataset, split, doc_id, 'Domain: ' || dataset || '. Event trigger and argument extraction. ' || plain AS input, o AS output FROM sent
    JOIN {_E2E.format(i=' | ', a='a1', o=' || ')} USING (sid)""", "us", "evargs"))(_expr("event_extraction_e2e"))

_AI = """(SELECT sid, string_agg({a}, ' | ' ORDER BY pos) AS o FROM evargs WHERE sid IN (SELECT sid FROM aeok) GROUP BY sid)"""
query("g6_ai", sql(f"""SELECT dataset, split, doc_id, 'Domain: ' || dataset || '. Identify potential arguments. ' || plain AS input, o AS output FROM sent
    JOIN {_AI.format(a='a3')} USING (sid)""", "evargs", "aeok"))(_expr("argument_identification_e2e"))


def _ae(roles="dim_roles"):
    """Asked roles and filled roles per argument-extraction instance."""
    return """filled AS (SELECT sid, pos, string_agg(role, ' | ' ORDER BY role_ord) AS asked, string_agg('=' || role, ' | ' ORDER BY role_ord) AS asked_eq,
        string_agg('=' || role, ' ## ' ORDER BY role_ord) AS asked_hash,
        string_agg(x, ' | ' ORDER BY role_ord) AS filled, string_agg(x, ' ## ' ORDER BY role_ord) AS filled_hash FROM (
      SELECT a.sid, a.pos, d.role, d.role_ord, coalesce('argument> ' || f.txt || '>=' || d.role, 'None=' || d.role) AS x
      FROM aeok a JOIN dim_roles d ON d.dataset = a.dataset AND d.event_type = a.etype
      LEFT JOIN (SELECT sid, pos, role, arg_min(txt, k) AS txt FROM arg WHERE txt <> '' GROUP BY ALL) f ON f.sid = a.sid AND f.pos = a.pos AND f.role = d.role) GROUP BY sid, pos)"""


query("g7_ae", sql("""SELECT a.dataset, a.split, a.doc_id, a.pos AS seq,
      'Domain: ' || a.dataset || '. Extract arguments for a specific event. argument> ' || asked || ' for trigger> ' || a.txt || '>=' || a.etype || ': ' || plain AS input,
      'trigger> ' || a.txt || '>=' || a.etype || ': ' || filled AS output FROM aeok a JOIN filled USING (sid, pos) JOIN (SELECT sid, plain FROM sent) USING (sid)""",
    "aeok", "arg", "dim_roles", extra=_ae()))(
    lambda spark, sf: instances.build_expressive(corpus(spark, sf), ONTO, tasks=["argument_extraction_pipeline"]).select(
        "dataset", "split", "doc_id", "seq", "input", "output"))

_WOVEN_IX = f"""woven_ix AS (SELECT sid, {clean("body || ' ' || array_to_string(tokens[last_e + 1:], ' ')")} AS tagged FROM (
    SELECT sid, string_agg(array_to_string(tokens[uprev + 1:s], ' ') || ' trigger ' || (p + 1) || '> ' || txt || '>', ' ' ORDER BY p) AS body, max_by(e, p) AS last_e
    FROM us JOIN (SELECT sid, tokens FROM sent) USING (sid) GROUP BY sid) JOIN (SELECT sid, tokens FROM sent) USING (sid)),
  kx AS (SELECT a.sid, a.pos, CASE WHEN u.p IS NOT NULL THEN u.p + 1 ELSE nu + r END AS k
    FROM (SELECT *, CASE WHEN raw_e > n THEN dense_rank() OVER (PARTITION BY sid, raw_e > n ORDER BY s) END AS r FROM aeok) a
    LEFT JOIN us u ON u.sid = a.sid AND u.s = a.s AND u.e = a.raw_e LEFT JOIN (SELECT sid, count(*) AS nu FROM us GROUP BY sid) c ON c.sid = a.sid),
  """ + _ae()
query("g8_with_index", sql(f"""SELECT dataset, split, doc_id, task, seq, event_id, input, output FROM (
    SELECT dataset, split, doc_id, 'trigger_identification' AS task, 0 AS seq, NULL AS event_id, 'domain: ' || dataset || '. trigger>: ' || plain AS input, tagged AS output
      FROM woven_ix JOIN sent USING (sid)
    UNION ALL SELECT dataset, split, doc_id, 'trigger_classification', 0, NULL, 'domain: ' || dataset || '. trigger>=type: ' || tagged, o
      FROM sent JOIN woven_ix USING (sid) JOIN (SELECT sid, string_agg('trigger ' || (p + 1) || '> ' || txt || '>=' || etype, ' | ' ORDER BY p) AS o FROM us GROUP BY sid) USING (sid)
    UNION ALL SELECT dataset, split, doc_id, 'argument_identification', 0, NULL, 'domain: ' || dataset || '. argument>: ' || plain, o FROM sent JOIN {_AI.format(a='a1')} USING (sid)
    UNION ALL SELECT a.dataset, a.split, a.doc_id, 'argument_extraction', a.pos, coalesce(a.id, a.pos::VARCHAR),
      'domain: ' || a.dataset || '. extract arguments ' || asked_eq || ' for event ' || a.etype || ' of trigger ' || k || '> ' || a.txt || '>: ' ||
        {clean("array_to_string(tokens[1:a.s], ' ') || ' trigger ' || k || '> ' || a.txt || '> ' || array_to_string(tokens[a.e + 1:], ' ')")},
      'arguments for event ' || a.etype || ' of trigger ' || k || '> ' || a.txt || '>: ' || filled
      FROM aeok a JOIN filled USING (sid, pos) JOIN kx USING (sid, pos) JOIN (SELECT sid, tokens FROM sent) USING (sid))""",
    "us", "aeok", "arg", "evargs", "dim_roles", extra=_WOVEN_IX))(
    lambda spark, sf: instances.build_indexed(corpus(spark, sf), ONTO).select("dataset", "split", "doc_id", "task", "seq", "event_id", "input", "output"))

query("g9_no_index", sql(f"""SELECT dataset, split, doc_id, task, seq, input, output FROM (
    SELECT dataset, split, doc_id, 'trigger_identification' AS task, 0 AS seq, 'domain: ' || dataset || '. trigger>: ' || plain AS input, tagged AS output FROM woven JOIN sent USING (sid)
    UNION ALL SELECT dataset, split, doc_id, 'trigger_classification', 0, 'domain: ' || dataset || '. trigger>=type: ' || plain, o
      FROM sent JOIN (SELECT sid, string_agg('trigger> ' || txt || '>=' || ptype, ' | ' ORDER BY j) AS o FROM sp GROUP BY sid) USING (sid)
    UNION ALL SELECT dataset, split, doc_id, 'trigger_identification_augument', 0, 'domain: ' || dataset || '. trigger words: ' || plain, o
      FROM sent JOIN (SELECT sid, string_agg(txt, ' | ' ORDER BY j) AS o FROM sp GROUP BY sid) USING (sid)
    UNION ALL SELECT dataset, split, doc_id, 'argument_identification', 0, 'domain: ' || dataset || '. argument>: ' || plain, o FROM sent JOIN {_AI.format(a='a1')} USING (sid)
    UNION ALL SELECT dataset, split, doc_id, 'event_extraction_e2e', 0, 'domain: ' || dataset || '. event extraction: ' || plain, o
      FROM sent JOIN {_E2E.format(i=' ## ', a='a2', o=' | ')} USING (sid)
    UNION ALL SELECT a.dataset, a.split, a.doc_id, 'argument_extraction', a.pos,
      'domain: ' || a.dataset || '. argument> ' || asked_eq || ' for trigger> ' || a.txt || '>=' || a.etype || ': ' || plain, 'trigger> ' || a.txt || '>=' || a.etype || ': ' || filled
      FROM aeok a JOIN filled USING (sid, pos) JOIN (SELECT sid, plain FROM sent) USING (sid))""",
    "us", "aeok", "arg", "evargs", "dim_roles", extra=_WOVEN + ", " + _ae()))(
    lambda spark, sf: instances.build_plain(corpus(spark, sf), ONTO).select("dataset", "split", "doc_id", "task", "seq", "input", "output"))

query("g10_no_index_hash", sql("""SELECT a.dataset, a.split, a.doc_id, a.pos AS seq,
      'domain: ' || a.dataset || '. trigger> ' || a.txt || '>=' || a.etype || ' | argument> ' || asked_hash || ': ' || plain AS input,
      'trigger> ' || a.txt || '>=' || a.etype || ' | ' || filled_hash AS output
      FROM aeok a JOIN filled USING (sid, pos) JOIN (SELECT sid, plain FROM sent) USING (sid)""", "aeok", "arg", "dim_roles", extra=_ae()))(
    lambda spark, sf: instances.build_plain(corpus(spark, sf), ONTO, hash_arguments=True).where(F.col("task") == "argument_extraction").select(
        "dataset", "split", "doc_id", "seq", "input", "output"))

query("g11_human", sql("""SELECT dataset, split, doc_id, 'Domain: ' || dataset || '. Classify trigger types end-to-end. ' || plain AS input, o AS output FROM sent
    JOIN (SELECT sid, string_agg('trigger> ' || txt || '>=' || coalesce(tag, ptype), ' | ' ORDER BY j) AS o FROM sp
      LEFT JOIN dim_tags d ON d.dataset = sp.dataset AND d.event_type = sp.ptype GROUP BY sid) USING (sid)""", "sp", "dim_tags"))(
    lambda spark, sf: instances.build_expressive(corpus(spark, sf), ONTO, tasks=["trigger_classification_e2e"], human=True).select(
        "dataset", "split", "doc_id", "input", "output"))

query("g12_all_tasks", sql("""SELECT dataset, task, count(*) AS n, sum(length(input))::BIGINT AS chars_in FROM (
    SELECT dataset, 'trigger_identification' AS task, 'Domain: ' || dataset || '. Identify trigger words. ' || plain AS input FROM sent WHERE sid IN (SELECT sid FROM sp)
    UNION ALL SELECT dataset, 'trigger_classification_pipeline', 'Domain: ' || dataset || '. Classify trigger types. ' || tagged FROM sent JOIN woven USING (sid)
    UNION ALL SELECT dataset, 'trigger_classification_e2e', 'Domain: ' || dataset || '. Classify trigger types end-to-end. ' || plain FROM sent WHERE sid IN (SELECT sid FROM sp)
    UNION ALL SELECT dataset, 'trigger_identification_augument', 'domain: ' || dataset || '. trigger words: ' || plain FROM sent WHERE sid IN (SELECT sid FROM sp)
    UNION ALL SELECT dataset, 'argument_identification_e2e', 'Domain: ' || dataset || '. Identify potential arguments. ' || plain FROM sent
      WHERE sid IN (SELECT sid FROM aeok) AND sid IN (SELECT sid FROM evargs)
    UNION ALL SELECT dataset, 'event_extraction_e2e', 'Domain: ' || dataset || '. Event trigger and argument extraction. ' || plain FROM sent WHERE sid IN (SELECT sid FROM sp)
    UNION ALL SELECT a.dataset, 'argument_extraction_pipeline', 'Domain: ' || a.dataset || '. Extract arguments for a specific event. argument> ' || asked || ' for trigger> ' || a.txt || '>=' || a.etype || ': ' || plain
      FROM aeok a JOIN filled USING (sid, pos) JOIN (SELECT sid, plain FROM sent) USING (sid)) GROUP BY ALL""",
    "sp", "aeok", "arg", "evargs", "dim_roles", extra=_WOVEN + ", " + _ae()))(
    lambda spark, sf: instances.build_expressive(corpus(spark, sf), ONTO).groupBy("dataset", "task").agg(
        F.count("*").alias("n"), F.sum(F.length("input")).alias("chars_in")))

_REMAP = """nt AS (SELECT ev.sid, ev.pos, coalesce(d.unified_type, ev.etype) AS nt FROM ev LEFT JOIN dim_map d ON d.dataset = ev.dataset AND d.original_type = ev.etype),
  nr AS (SELECT a.sid, a.pos, a.k, a.txt, coalesce(x.unified_role, y.unified_role, a.role) AS nr FROM arg a
    LEFT JOIN dim_role_map x ON x.dataset = a.dataset AND x.original_type = a.etype AND x.original_role = a.role
    LEFT JOIN (SELECT dataset, original_type, lower(original_role) AS low, arg_min(unified_role, ord) AS unified_role FROM dim_role_map GROUP BY ALL) y
      ON y.dataset = a.dataset AND y.original_type = a.etype AND y.low = lower(a.role)),
  seen AS (SELECT sid, pos, nr, min(k) AS k0, arg_min(txt, k) FILTER (WHERE txt <> '') AS txt FROM nr GROUP BY ALL)"""
query("g13_combined", sql(f"""SELECT source_dataset, split, doc_id, task, seq, input, output FROM (
    SELECT dataset AS source_dataset, split, doc_id, 'event_extraction_e2e' AS task, 0 AS seq, 'Domain: news. Event trigger and argument extraction. ' || plain AS input, o AS output FROM sent JOIN (
      SELECT sid, string_agg('trigger>' || txt || '>=' || nt || coalesce(' | ' || a, ''), ' || ' ORDER BY p) AS o FROM us JOIN nt USING (sid, pos)
      LEFT JOIN (SELECT sid, pos, string_agg('argument>' || txt || '>=' || nr, ' | ' ORDER BY k) AS a FROM nr WHERE txt <> '' GROUP BY ALL) USING (sid, pos) GROUP BY sid) USING (sid)
    UNION ALL SELECT a.dataset, a.split, a.doc_id, 'argument_extraction_pipeline', a.pos,
      'Domain: news. Extract arguments for a specific event. argument> ' || asked || ' for trigger> ' || a.txt || '>=' || nt || ': ' || plain,
      'trigger> ' || a.txt || '>=' || nt || ': ' || filled FROM aeok a JOIN nt USING (sid, pos) JOIN (SELECT sid, plain FROM sent) USING (sid)
      JOIN (SELECT sid, pos, string_agg(nr, ' | ' ORDER BY k0) AS asked, string_agg(coalesce('argument> ' || txt || '>=' || nr, 'None=' || nr), ' | ' ORDER BY k0) AS filled FROM seen GROUP BY ALL) USING (sid, pos))
    WHERE source_{_COMB}""", "us", "aeok", "arg", "dim_map", "dim_role_map", extra=_REMAP))(
    lambda spark, sf: instances.build_expressive(
        harmonise.remap_corpus(combined(spark, sf), ONTO), ONTO, domain="news", augment=False,
        tasks=["event_extraction_e2e", "argument_extraction_pipeline"]).select("source_dataset", "split", "doc_id", "task", "seq", "input", "output"))


@query("g15_bio", sql("""SELECT doc_id, string_agg(c, '' ORDER BY i) AS codes FROM (
      SELECT x.doc_id, x.i, CASE WHEN bool_or(x.i = s) THEN '1' WHEN bool_or(x.i > s AND x.i < e) THEN '2' ELSE '0' END AS c
      FROM (SELECT sid, doc_id, generate_subscripts(tokens, 1) - 1 AS i FROM sent) x JOIN sp USING (sid) GROUP BY ALL) GROUP BY doc_id""", "sp"))
def g15(spark, sf):
    en = spans.drop_no_trigger(corpus(spark, sf))
    labels = F.transform("tokens", lambda t, i: F.when(F.exists("spans", lambda x: x["s"] == i), "B-Trigger").when(
        F.exists("spans", lambda x: (x["s"] < i) & (i < x["e"])), "I-Trigger").otherwise("O-Trigger"))
    return en.select("doc_id", F.array_join(F.transform(instances.encode_labels(labels), lambda x: x.cast("string")), "").alias("codes"))


# ---- T -----------------------------------------------------------------------------------------
query("t1_clean_punct", f"SELECT doc_id, {clean('text')} AS text FROM documents")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", T.clean_punct(F.col("text")).alias("text")))
query("t2_plain_text", sql("SELECT doc_id, plain FROM sent", "sent"))(
    lambda spark, sf: corpus(spark, sf).select("doc_id", T.detokenise(F.col("tokens")).alias("plain")))
query("t3_space_punct", f"SELECT doc_id, {spaced('text')} AS text FROM documents")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", T.space_punct(F.col("text")).alias("text")))
query("t4_clean_ws", f"SELECT doc_id, {ws('text')} AS text FROM documents")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", T.clean_ws(F.col("text")).alias("text")))


@query("t5_arg_text", sql("SELECT doc_id, pos, row_number() OVER (PARTITION BY sid, pos ORDER BY k) - 1 AS apos, txt AS text FROM arg", "arg"))
def t5(spark, sf):
    en = spans.enrich(corpus(spark, sf)).select("doc_id", F.explode("mentions").alias("m"))
    return en.select("doc_id", F.col("m.pos").cast("long").alias("pos"), F.posexplode("m.args").alias("apos", "a")).select(
        "doc_id", "pos", F.col("apos").cast("long").alias("apos"), "a.text")


@query("t6_arg_role", sql("SELECT doc_id, pos, row_number() OVER (PARTITION BY sid, pos ORDER BY k) - 1 AS apos, role FROM arg", "arg"))
def t6(spark, sf):
    a = mentions(spark, sf).select("doc_id", "pos", F.posexplode("e.arguments").alias("apos", "a"))
    return a.select("doc_id", "pos", F.col("apos").cast("long").alias("apos"), F.coalesce(spans.arg_role(F.col("a")), F.lit("Unknown")).alias("role"))


_SRC3 = "string_split(text, '. ')"
_P2 = f"array_to_string({_SRC3}[3:], '. ')"
query("t7_strip_prompt", f"""SELECT doc_id, CASE WHEN len({_SRC3}) >= 3 THEN {strip(_P2)} WHEN len({_SRC3}) = 2 THEN {strip(_SRC3 + '[2]')} ELSE text END AS text FROM documents""")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", T.strip_prompt(F.col("text")).alias("text")))
query("t8_prefix_len", f"""SELECT doc_id, (CASE WHEN len({_SRC3}) >= 3 THEN length({_SRC3}[1]) + length({_SRC3}[2]) + 4 WHEN len({_SRC3}) = 2 THEN length({_SRC3}[1]) + 2 ELSE 0 END)::BIGINT AS n FROM documents""")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", T.prefix_len(F.col("text")).cast("long").alias("n")))
query("t13_slice_span", sql("SELECT doc_id, pos, substring(plain, s + 1, raw_e - s + 1) AS text FROM ev JOIN (SELECT sid, plain FROM sent) USING (sid) WHERE valid", "ev"))(
    lambda spark, sf: spans.enrich(corpus(spark, sf)).select("doc_id", "plain", F.explode(F.filter("mentions", lambda m: m["valid"])).alias("m")).select(
        "doc_id", F.col("m.pos").cast("long").alias("pos"), T.slice_span(F.col("plain"), F.col("m.s"), F.col("m.raw_e")).alias("text")))
query("t14_result_key", f"""SELECT doc_id, doc_id || '::' || lang || '::' || source || '::' || left({ws('text')}, 80) AS result_key FROM documents""")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", T.result_key(F.col("doc_id").cast("string"), F.col("lang"), F.col("source"), F.col("text")).alias("result_key")))
query("t16_format_offset", sql("SELECT doc_id, pos, CASE WHEN valid THEN '[' || s || ', ' || raw_e || ']' ELSE '[]' END AS shown FROM ev", "ev"))(
    lambda spark, sf: mentions(spark, sf).select("doc_id", "pos", T.format_offset(
        F.col("e.trigger.start").cast("int"), F.when(F.col("e.trigger.end").cast("int") > F.col("e.trigger.start").cast("int"), F.col("e.trigger.end").cast("int"))).alias("shown")))
query("t18_parse_int", """SELECT event_id, coalesce(try_cast(nullif(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN event_type ELSE json_extract_string(props, '$.k') END, '') AS BIGINT), 512) AS n FROM events""")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", T.parse_int(
        F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.get_json_object("props", "$.k")), 512).alias("n")))
