"""Span handling over corpus rows, in-row: no operator here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import between, clean_punct, detokenise, first_truthy, let, truthy


def py_slice(tokens: Column, s: Column, e: Column) -> Column:
    """``tokens[s:e]`` with Python's treatment of negative and oversized bounds."""
    n = F.size(tokens)
    lo = F.when(s < 0, F.greatest(s + n, F.lit(0))).otherwise(F.least(s, n))
    hi = F.when(e < 0, F.greatest(e + n, F.lit(0))).otherwise(F.least(e, n))
    return let(F.struct(lo.alias("lo"), hi.alias("hi")), lambda b: between(tokens, b["lo"], b["hi"]))


def span_text(tokens: Column, s: Column, e: Column) -> Column:
    return clean_punct(F.array_join(py_slice(tokens, s, e), " "))


def _pos(c: Column) -> Column:
    return c.try_cast("int")


def entity_text(tokens: Column, entities: Column, entity_id: Column) -> Column:
    """Text of the first listed entity with this id and usable positions."""
    hit = F.get(F.filter(
        entities,
        lambda x: (F.coalesce(x["id"] == entity_id, F.lit(False)) | F.coalesce(x["entity_id"] == entity_id, F.lit(False)))
        & _pos(x["start"]).isNotNull() & _pos(x["end"]).isNotNull()), F.lit(0))
    return let(hit, lambda h: F.when(h.isNotNull(), span_text(tokens, _pos(h["start"]), _pos(h["end"]))))


def arg_text(tokens: Column, entities: Column, a: Column) -> Column:
    """T5: text, else span, else own positions, else the entity; NULL when nothing applies."""
    return (
        F.when(truthy(a["text"]).isNotNull(), clean_punct(a["text"]))
        .when(truthy(a["span"]).isNotNull(), clean_punct(a["span"]))
        .when(_pos(a["start"]).isNotNull() & _pos(a["end"]).isNotNull(), span_text(tokens, _pos(a["start"]), _pos(a["end"])))
        .when(a["entity_id"].isNotNull(), entity_text(tokens, entities, a["entity_id"]))
    )


def arg_role(a: Column) -> Column:
    """T6 without its default."""
    return first_truthy(a["role"], a["role_type"], a["label"])


def enrich(corpus: DataFrame) -> DataFrame:
    """One pass that prepares everything the instance builders need.

    Adds ``n``, ``plain``, ``mentions`` (every event, in list order, with resolved arguments),
    ``spans`` (valid triggers sorted by position, repeats kept) and ``uspans`` (first event per span).
    """
    tokens, entities = F.col("tokens"), F.col("entity_mentions")
    n = F.size("tokens")

    def mention(e, i):
        s, raw_e = _pos(e["trigger"]["start"]), _pos(e["trigger"]["end"])
        return F.struct(
            i.alias("pos"), e["id"].alias("id"), truthy(e["event_type"]).alias("type"),
            s.alias("s"), raw_e.alias("raw_e"),
            _valid(e, n).alias("valid"),
            F.least(raw_e, n).alias("e"),
            span_text(tokens, s, raw_e).alias("text"),
            F.coalesce(F.size(e["arguments"]), F.lit(0)).alias("n_args"),
            F.transform(
                F.coalesce(e["arguments"], F.array().cast(_ARGS)),
                lambda a: F.struct(
                    arg_text(tokens, entities, a).alias("text"),
                    F.coalesce(arg_role(a), F.lit("Unknown")).alias("role"),
                    arg_role(a).alias("own_role"))).alias("args"))

    mentions = F.transform(F.coalesce("event_mentions", F.array().cast(_EVENTS)), mention)
    # Bound, as Spark would put the expression of a list wherever the list is used, within lambdas too.
    lists = let(mentions, lambda ms: let(sorted_spans(ms), lambda ss: F.struct(
        ms.alias("mentions"), ss.alias("spans"), first_per_span(ss).alias("uspans"))))
    return (
        corpus.withColumn("n", n)
        .withColumn("plain", detokenise(tokens))
        .withColumn("_lists", lists)
        .withColumns({c: F.col(f"_lists.{c}") for c in ("mentions", "spans", "uspans")}).drop("_lists")
    )


def _valid(e: Column, n: Column) -> Column:
    s, raw_e = _pos(e["trigger"]["start"]), _pos(e["trigger"]["end"])
    return F.coalesce((s >= 0) & (raw_e > s) & (s < n), F.lit(False))


def has_span(corpus: DataFrame) -> DataFrame:
    """The rows whose ``spans`` will not be empty, told from the events as stored: a filter on ``spans`` would make them twice."""
    return corpus.where(F.exists(F.coalesce("event_mentions", F.array().cast(_EVENTS)), lambda e: _valid(e, F.size("tokens"))))


_ARGS = ("array<struct<text:string,span:string,start:string,end:string,entity_id:string,"
         "role:string,role_type:string,label:string>>")
_EVENTS = ("array<struct<id:string,event_type:string,trigger:struct<start:string,end:string>,"
           f"arguments:{_ARGS}>>")


def sorted_spans(mentions: Column) -> Column:
    """F1 + O1: valid spans ordered by ``(s, e)``, list order among equals."""
    keyed = F.transform(
        F.filter(mentions, lambda x: x["valid"]),
        lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["pos"].alias("pos"), x["raw_e"].alias("raw_e"),
                           x["type"].alias("type"), x["text"].alias("text"), x["args"].alias("args")))
    return F.array_sort(keyed)


def first_per_span(spans: Column) -> Column:
    """Of equal spans the first listed event survives."""
    def fresh(xs):
        def one(x, i):
            prev = F.get(xs, i - 1)
            return (i == 0) | (prev["s"] != x["s"]) | (prev["e"] != x["e"])
        return one
    return let(spans, lambda xs: F.filter(xs, fresh(xs)))


def primary_type(spans: Column, mentions: Column, x: Column, compat: bool = False) -> Column:
    """Type of the first event on this span.

    ``compat`` compares the stored end with the clamped one, which turns clamped spans into Unknown (Q4).
    """
    if compat:
        hit = F.filter(mentions, lambda y: (y["s"] == x["s"]) & (y["raw_e"] == x["e"]))
    else:
        hit = F.filter(spans, lambda y: (y["s"] == x["s"]) & (y["e"] == x["e"]))
    return F.coalesce(F.get(hit, F.lit(0))["type"], F.lit("Unknown"))


def weave(tokens: Column, spans: Column, tag) -> Column:
    """The sentence with every span replaced by ``tag(text, index)``; the cursor is the previous span's end."""
    def woven(xs):
        def piece(x, i):
            prev = F.when(i == 0, 0).otherwise(F.get(xs, i - 1)["e"])
            return F.array_append(let(prev, lambda p: between(tokens, p, x["s"])), tag(x["text"], i))
        last = F.coalesce(F.try_element_at(xs, F.lit(-1))["e"], F.lit(0))
        return F.concat(F.flatten(F.transform(xs, piece)), between(tokens, last, F.size(tokens)))
    return clean_punct(F.array_join(let(spans, woven), " "))


# ---- table forms ---------------------------------------------------------------------------
def valid_spans(corpus: DataFrame) -> DataFrame:
    """F1 as rows: one valid, clamped trigger per event mention."""
    return enrich(corpus).select("dataset", "split", "doc_id", F.explode("spans").alias("x")).select(
        "dataset", "split", "doc_id", "x.pos", "x.s", "x.e", "x.text", "x.type")


def drop_no_trigger(corpus: DataFrame) -> DataFrame:
    """documents with at least one valid trigger."""
    return enrich(has_span(corpus))


def quarantine(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows the builders can use, and the rest with a reason."""
    bad = F.coalesce(F.size("tokens"), F.lit(0)) <= 0
    return corpus.where(~bad), corpus.where(bad).withColumn("reason", F.lit("no tokens"))


def ae_eligible(enriched: DataFrame) -> DataFrame:
    """one row per valid event with at least one argument."""
    return enriched.select("*", F.explode(F.filter("mentions", lambda x: x["valid"] & (x["n_args"] > 0))).alias("ev"))
