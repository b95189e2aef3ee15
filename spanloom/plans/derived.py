"""An annotated corpus derived from the ``documents`` table, by arithmetic only.

The given tables hold no event annotation, so the registered queries run over this corpus: every
line of every document becomes a tokenised sentence with triggers, arguments and entities placed
by modular arithmetic.  It contains malformed, clamped and duplicate spans on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import between, let, result_key, space_punct
from spanloom.ontology import Ontology, starter_ontology
from spanloom.operators.parse import detect, structure_modes
from spanloom.operators.spans import enrich, has_span, weave
from spanloom.schema import ENTITY, EVENT
from spanloom.session import materialise

LANG_DATASET = {"en": "geneva", "fr": "m2e2", "de": "wikievents", "es": "rams"}
OTHER_DATASET = "geneva"
# A sentence is numbered by its document and line: room for 67 million lines a text and 137 thousand million documents.
LINES = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, small: int = 1 << 30, task: int = 1 << 22) -> DataFrame:
    """Deal an input out anew where its files could not be read by enough tasks: a file may be a single row group, whatever its size.

    There is a task for each ``task`` bytes, and one for each core at least.  The number of cores alone would not do: a task would
    grow with the input, and a session that has just started counts only the executors that have come so far.  An input of
    ``small`` bytes or more that has that many files is read as it is.
    """
    size = _bytes(df)
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // task))
    return df if size >= small and len(df.inputFiles()) >= wanted else df.repartition(wanted)


def dealt(df: DataFrame, task: int = 1 << 22) -> DataFrame:
    """Deal a derived table to a task for each ``task`` bytes where a scan would give its tasks more.

    Its rows take long to work on, and a scan packs files into tasks of 128 MB.
    """
    wanted = -(-_bytes(df) // task)
    return df if wanted <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(wanted)


def sentences(documents: DataFrame) -> DataFrame:
    """One row per non-blank line; other languages go to ``OTHER_DATASET``."""
    ds = F.create_map(*[F.lit(x) for kv in LANG_DATASET.items() for x in kv])
    # Tokenising inside the generator computes it once; a later filter would otherwise repeat it.
    lines = F.transform(F.split("text", "\n", -1), lambda line: F.split(space_punct(line), " "))
    return (
        documents.select("doc_id", "lang", F.posexplode(lines).alias("line_no", "tokens"))
        .where((F.size("tokens") > 1) | (F.get("tokens", F.lit(0)) != ""))
        .select(
            F.col("doc_id").alias("src_id"),
            (F.col("doc_id") * LINES + F.col("line_no")).alias("sid"),
            (F.col("doc_id") * 1000 + F.col("line_no")).alias("m"),
            F.coalesce(ds[F.col("lang")], F.lit(OTHER_DATASET)).alias("dataset"),
            F.when(F.col("doc_id") % 10 == 8, "val").when(F.col("doc_id") % 10 == 9, "test").otherwise("train").alias("split"),
            "tokens")
    )


def build_corpus(documents: DataFrame, ontology: Ontology | None = None) -> DataFrame:
    """Corpus rows ``dataset, split, doc_id, sid, tokens, event_mentions, entity_mentions``."""
    onto = ontology or starter_ontology()
    first4 = {ds: list(onto.roles[ds])[:4] for ds in LANG_DATASET.values()}
    type_of = F.create_map(*[
        x for ds, ts in first4.items() for x in (F.lit(ds), F.array(*[F.lit(t) for t in ts]))])
    def by_type(shape):
        return F.create_map(*[
            x for ds, ts in first4.items() for t in ts
            for x in (F.lit(t), F.array(*[shape(F.lit(r)) for r in onto.roles[ds][t][:4]]))])

    # Constants, so nothing is put into upper case for each row.
    roles_of, loud_of = by_type(lambda r: r), by_type(F.upper)
    n = F.size("tokens")
    m = F.col("m")

    none = F.lit(None).cast("string")

    def argument(i, both, k):
        start, end = i + 2 + 2 * k, i + 3 + 2 * k + k % 2
        role = F.when((m + k) % 7 == 0, F.get(both["loud"], k)).otherwise(F.get(both["roles"], k))
        style = (m + k) % 4
        text = F.array_join(between(F.col("tokens"), start, end), " ")
        alt = (m + k) % 11 == 0
        return F.struct(
            F.when(style == 1, text).alias("text"),
            F.when(style == 3, text).alias("span"),
            F.when(style == 0, start.cast("string")).alias("start"),
            F.when(style == 0, end.cast("string")).alias("end"),
            F.when(style == 2, F.concat_ws("", F.lit("T"), start.cast("string"), F.lit("_"), end.cast("string"))).alias("entity_id"),
            F.when(~alt, role).alias("role"),
            F.when(alt, role).alias("role_type"),
            none.alias("label"))

    def event(i, shift):
        etype = F.get(types, ((m + i) % 4 + shift) % 4)
        end = (
            F.when((m + i) % 97 == 0, i).when((m + i) % 53 == 0, n + 3)
            .otherwise(i + 1 + F.when((m + i) % 5 == 0, 1).otherwise(0)))
        slots = F.filter(
            F.array(*[F.lit(k) for k in range(4)]),
            lambda k: ((m + i + k) % 2 == 0) & (i + 3 + 2 * k + k % 2 <= n))
        both = let(etype, lambda t: F.struct(roles_of[t].alias("roles"), loud_of[t].alias("loud")))
        args = let(both, lambda b: F.transform(
            F.filter(slots, lambda k: k < F.size(b["roles"])), lambda k: argument(i, b, k)))
        return F.struct(
            F.when(i % 2 == 0, F.concat(F.when(shift == 0, "e").otherwise("d"), i.cast("string"))).alias("id"),
            etype.alias("event_type"),
            F.struct(i.cast("string").alias("start"), end.cast("string").alias("end")).alias("trigger"),
            args.alias("arguments"))

    types = type_of[F.col("dataset")]
    # Every 17th place, counted off rather than asked of every token.
    first = F.pmod(-F.pmod(m, F.lit(17)), F.lit(17)).cast("int")
    places = F.when(first < n, F.sequence(first, n - 1, F.lit(17)))
    hits = F.coalesce(F.filter(places, lambda i: F.length(F.get("tokens", i)) >= 6), F.array().cast("array<int>"))
    events = F.flatten(F.transform(
        F.col("hits"),
        lambda i: F.transform(
            F.when((m + i) % 19 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))),
            lambda shift: event(i, shift))))

    def entity(a):
        pos = F.split(F.substring(a["entity_id"], F.lit(2), F.length(a["entity_id"])), "_")
        even = F.get(pos, F.lit(0)).cast("int") % 2 == 0
        return F.struct(
            F.when(even, a["entity_id"]).alias("id"), F.when(~even, a["entity_id"]).alias("entity_id"),
            F.get(pos, F.lit(0)).alias("start"), F.get(pos, F.lit(1)).alias("end"))

    refs = F.filter(F.flatten(F.transform("event_mentions", lambda e: e["arguments"])), lambda a: a["entity_id"].isNotNull())
    return (
        sentences(documents)
        .withColumn("hits", hits)
        .withColumn("event_mentions", events.cast(f"array<{EVENT}>"))
        .withColumn("entity_mentions", F.array_distinct(F.transform(refs, entity)).cast(f"array<{ENTITY}>"))
        .select("dataset", "split", F.concat(F.lit("doc_"), F.col("sid").cast("string")).alias("doc_id"),
                "sid", "src_id", "tokens", "event_mentions", "entity_mentions")
    )


_TABLES: dict = {}


def shared(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """``build()`` written once per session as a table in the shared folder, then read back.

    The queries share their derived inputs the way jobs share a table: each reads only the columns it needs.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = materialise(build(), name)
    return _TABLES[key]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "corpus", lambda: build_corpus(table(spark, sf_dir, "documents")))


# ---- model outputs derived from the corpus ----------------------------------------------------
def build_outputs(corpus_df: DataFrame, ontology: Ontology | None = None) -> DataFrame:
    """Linearised predictions of every task per sentence, edited so that parsers meet errors.

    The direct (``e2e``) outputs use the same edits shifted by one, so that the modes differ.  Edits by
    event position ``p``: drop, change the type, append a word to arguments, swap the first two events.
    """
    onto = ontology or starter_ontology()
    first4 = {ds: list(onto.roles[ds])[:4] for ds in LANG_DATASET.values()}
    types_of = F.create_map(*[x for ds, ts in first4.items() for x in (F.lit(ds), F.array(*[F.lit(t) for t in ts]))])
    m = F.col("src_id") * 1000 + F.col("sid") % LINES
    types = types_of[F.col("dataset")]

    def edited(q):
        def one(x, p):
            at = F.array_position(types, x["type"]).cast("int") - 1
            etype = F.when((q + p) % 7 == 0, F.get(types, (at + 1) % 4)).otherwise(x["type"])
            return F.when((q + p) % 5 != 0, F.struct(
                p.alias("p"), x["text"].alias("text"), etype.alias("type"),
                F.transform(F.filter(x["args"], lambda a: a["text"] != ""), lambda a: F.struct(
                    F.when((q + p) % 6 == 0, F.concat(a["text"], F.lit(" zzz"))).otherwise(a["text"]).alias("text"),
                    a["role"].alias("role"))).alias("args")))
        kept = F.filter(F.transform("uspans", one), lambda x: x.isNotNull())
        return let(kept, lambda k: F.when(
            (q % 13 == 0) & (F.size(k) > 1), F.concat(F.array(F.get(k, F.lit(1)), F.get(k, F.lit(0))), F.slice(k, F.lit(3), F.size(k)))
        ).otherwise(k))

    def extraction(q):
        def one(x):
            args = F.transform(x["args"], lambda a: F.concat(F.lit("argument> "), a["text"], F.lit(">="), a["role"]))
            none = F.when((q + x["p"]) % 2 == 0, F.array(F.lit("None=Time"))).otherwise(F.array().cast("array<string>"))
            return F.concat(F.lit("trigger> "), x["text"], F.lit(">="), x["type"], F.lit(": "), F.array_join(F.concat(args, none), " | "))
        return one

    def whole(x):
        head = F.concat(F.lit("trigger>"), x["text"], F.lit(">="), x["type"])
        args = F.transform(x["args"], lambda a: F.concat(F.lit("argument>"), a["text"], F.lit(">="), a["role"]))
        return F.array_join(F.concat(F.array(head), args), " | ")

    def reference(x):
        # One argument in four is missing from the references, so that there are false positives.
        listed = F.filter(x["args"], lambda a, j: (a["text"] != "") & ((m + x["pos"] + j) % 4 != 0))
        args = F.transform(listed, lambda a: F.concat(
            F.lit("argument> "), a["text"], F.lit(">="), a["role"]))
        return F.concat(F.lit("trigger> "), x["text"], F.lit(">="), x["type"], F.lit(": "), F.array_join(args, " | "))

    return (
        enrich(has_span(corpus_df))
        .withColumn("m", m)
        .withColumn("a", edited(F.col("m"))).withColumn("b", edited(F.col("m") + 1))
        .select(
            "dataset", "split", "doc_id", "sid", "src_id", "m", F.col("plain").alias("source"),
            F.array_join(F.transform("a", lambda x: F.concat(x["text"], F.lit("="), x["type"])), " | ").alias("tc_pipeline"),
            F.array_join(F.transform("b", lambda x: F.concat(F.lit("trigger> "), x["text"], F.lit(">="), x["type"])), " | ").alias("tc_e2e"),
            F.array_join(F.transform("b", whole), " || ").alias("e2e_text"),
            F.transform("a", extraction(F.col("m"))).alias("ae_pipeline"),
            F.transform("b", extraction(F.col("m") + 1)).alias("ae_e2e"),
            weave(F.col("tokens"), F.col("uspans"), lambda t, i: F.concat(F.lit("trigger> "), t, F.lit(">"))).alias("ti"),
            F.transform(F.filter("mentions", lambda x: x["valid"] & (x["n_args"] > 0)), reference).alias("ae_refs"))
        .withColumn("ae_merged", F.concat("ae_pipeline", "ae_e2e"))
    )


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "outputs", lambda: build_outputs(dealt(corpus(spark, sf_dir))))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis runs: one row per sentence with events of every mode."""
    def build():
        df = structure_modes(detect(dealt(outputs(spark, sf_dir))))
        model = F.when(F.col("src_id") % 3 == 0, "cross-domain").otherwise("domain-specific")
        return df.select(
            result_key(F.col("doc_id"), F.col("dataset"), model, F.col("source")).alias("result_key"),
            "doc_id", "dataset", model.alias("model_type"), "source", "sid", "src_id",
            F.timestamp_seconds(F.lit(1704067200) + F.col("src_id") * 60).alias("analyzed_at"),
            "pipeline", "e2e", "merged", "complete_e2e")
    return shared(spark, sf_dir, "runs", build)
