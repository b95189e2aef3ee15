"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Three base kinds are found in every text: ``assign``, ``access`` and ``hex``.  A fourth, ``owned``, is any run of 20 or more key
characters with letters, digits and at least ``MIN_DISTINCT`` different characters.  All candidates are counted across the
corpus by a hash of the secret itself: in how many repositories and by how many owners it occurs.  A candidate held by
``example_owners`` owners or more is a widely copied example; one held by fewer looks live.  Base spans are always reported;
an ``owned`` span is added where it looks live and overlaps no base span of its text.

Positions are code points, ends exclusive.  Matches are located by splitting the text at them, and their starts are running
sums of piece lengths, taken in blocks so that a text with very many matches stays near linear.  Only spans, never texts, are
shuffled; counting goes by (secret, owner, repository) first, so a secret found in a third of all texts is combined map-side,
and the join back to the places is one that Spark may split by skew.

Defined cases: null text is empty; null owners and repositories count as one unnamed owner or repository; rows with one id and
one text are one document with two rows in the result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import let
from spanloom.llm.words import NULL_ID, apart, docs_table, restore_id, source
from spanloom.session import materialise

KINDS = ["assign", "access", "hex", "owned"]
_KEY = ("[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
ASSIGN = "(" + _KEY + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# A maximal run that is too short is dropped, so asking for the length at once finds the same spans; not so for ``assign``.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
OWNED = "[A-Za-z0-9+/_-]{20,}"
LEAST_VALUE = 6
MIN_DISTINCT = 10
_BLOCK = 256


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0).cast("long"), lambda a, x: a + x)


def _starts(steps: Column) -> Column:
    """Sums of all elements before each element."""
    def with_blocks(s: Column) -> Column:
        n_blocks = F.ceil(F.size(s) / F.lit(_BLOCK)).cast("int")
        sums = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: _sum(F.slice(s, b * _BLOCK + 1, _BLOCK)))

        def placed(sums: Column) -> Column:
            heads = F.transform(sums, lambda _, b: _sum(F.slice(sums, F.lit(1), b)))
            inside = lambda h, b: F.transform(
                F.slice(s, b * _BLOCK + 1, _BLOCK), lambda _, i: h + _sum(F.slice(s, b * _BLOCK + 1, i)))
            return F.flatten(F.transform(heads, inside))
        return let(sums, placed)
    return F.when(F.size(steps) > 0, let(steps, with_blocks)).otherwise(F.array().cast("array<bigint>"))


def _spans(text: Column, number: int, pattern: str) -> Column:
    """Matches as ``array<struct<start, end, kind, text>>``."""
    def located(hit: Column, piece: Column) -> Column:
        # Start of match i: the pieces up to i and the matches before it.
        steps = F.zip_with(piece, hit, lambda p, m: F.length(p).cast("long") + F.coalesce(F.length(m), F.lit(0)))
        starts = _starts(steps)
        return F.zip_with(hit, F.zip_with(starts, piece, lambda s, p: s + F.length(p)), lambda m, s: F.struct(
            s.alias("start"), (s + F.length(m)).alias("end"), F.lit(number).alias("kind"), m.alias("text")))
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hit: let(F.split(text, pattern, -1), lambda piece: located(hit, piece)))
    kept = F.filter(found, lambda s: s["text"].isNotNull())
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,text:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), kept).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, owner, repo) without the text, with ``text_key``, ``base`` and ``extra`` spans.

    ``base`` and ``extra`` are ``array<struct<start, end, kind, secret>>``; ``secret`` is a hash of the secret itself.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda s: F.when(s["kind"] == 0, F.regexp_extract(s["text"], ASSIGN, 2)).otherwise(s["text"])
    hashed = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.xxhash64(value(s)).alias("secret"))
    assign = F.filter(_spans(text, 0, ASSIGN), lambda s: F.length(value(s)) >= LEAST_VALUE)
    found = docs.select("doc_id", "owner", "repo", F.xxhash64(text).alias("text_key"), text.alias("text"), F.rlike(text, F.lit(OWNED)).alias("_long"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,text:string>>")
    long = lambda spans: F.when(F.col("_long"), spans).otherwise(none)  # noqa: E731  both hold a run of 20 key characters
    base = F.array_sort(F.transform(F.concat(assign, long(_spans(F.col("text"), 1, ACCESS)), long(_spans(F.col("text"), 2, HEX))), hashed),
                        lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["kind"] - b["kind"]))
    mixed = lambda s: F.rlike(s["text"], F.lit("[0-9]")) & F.rlike(s["text"], F.lit("[A-Za-z]")) & (
        F.size(F.array_distinct(F.split(s["text"], ""))) >= MIN_DISTINCT)
    extra = F.transform(F.filter(long(_spans(F.col("text"), 3, OWNED)), mixed), hashed)
    table = found.select("doc_id", "owner", "repo", "text_key", base.alias("base"), extra.alias("extra"))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return table.withColumn("extra", F.filter("extra", free))


def ownership(found: DataFrame, example_owners: int = 3) -> DataFrame:
    """``secret, n_owners, n_repos, n_places, verdict`` over all candidates of the corpus."""
    places = found.select("owner", "repo", F.explode(F.concat("base", "extra")).alias("s")).select("owner", "repo", "s.secret")
    each = places.groupBy("secret", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = each.groupBy("secret", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    total = by_owner.groupBy("secret").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repos"), F.sum("n").alias("n_places"))
    return total.withColumn("verdict", F.when(F.col("n_owners") >= example_owners, "example").otherwise("live"))


def judged(found: DataFrame, example_owners: int = 3, which=("base", "extra")) -> DataFrame:
    """``doc_id, text_key, start, end, kind, verdict``: every place with what the corpus says of its secret."""
    spans = F.explode(F.array_distinct(F.concat(*which))).alias("s")
    places = found.select("doc_id", "text_key", *which).distinct().select("doc_id", "text_key", spans).select("doc_id", "text_key", "s.*")
    return places.join(ownership(found, example_owners).select("secret", "verdict"), "secret").drop("secret")


def _named(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, example_owners: int = 3) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example`` for each row of ``docs`` (doc_id, text, owner, repo)."""
    found = materialise(candidates(docs), "secret-candidates")
    places = judged(found, example_owners)
    span = F.struct("start", "end", "kind")
    per_doc = places.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") == 3) & (F.col("verdict") == "live"), span))).alias("added"),
        F.count_if(F.col("verdict") == "live").alias("n_live"), F.count_if(F.col("verdict") == "example").alias("n_example"))
    with_any = found.where((F.size("base") > 0) | (F.size("extra") > 0)).join(per_doc, ["doc_id", "text_key"])
    without = found.where((F.size("base") == 0) & (F.size("extra") == 0))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")
    rows = with_any.unionByName(without.select("*", none.alias("added"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example")))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    order = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["kind"] - b["kind"])
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_named(plain).cast("binary"), 256).alias("base_sha256"),
                       _named(F.array_sort(F.concat(plain, "added"), order)).alias("spans"), "n_live", "n_example")


def masked(docs: DataFrame, example_owners: int = 3, mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` (documents' columns) with every live-looking secret replaced by ``mask``; ``n_chars`` follows.

    Widely copied examples stay as they are.  Only rows that may hold a secret are shuffled, to meet their spans.
    """
    key, text_key, live = apart(docs, "_id", "_key", "_spans")
    rows = docs.withColumns({key: F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)), text_key: F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))})
    maybe = F.coalesce(F.rlike("text", F.lit(ASSIGN)) | F.rlike("text", F.lit(OWNED)), F.lit(False))
    found = materialise(candidates(owned_documents(docs.where(maybe))), "secret-candidates")
    places = judged(found, example_owners).where("verdict = 'live'")
    spans = places.groupBy(F.col("doc_id").alias(key), F.col("text_key").alias(text_key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(live))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def cut(acc, s):
        gap = F.when(s["start"] >= acc["at"], F.concat(F.col("text").substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))).otherwise("")
        return F.struct(F.concat(acc["out"], gap).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
    clean = F.aggregate(live, start, cut, lambda acc: F.concat(acc["out"], F.col("text").substr((acc["at"] + 1).cast("int"), F.length("text"))))
    hit = rows.where(maybe).join(spans, [key, text_key], "left")
    hit = hit.withColumn("text", F.when(F.col(live).isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.when(F.col(live).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.where(~maybe).select(*docs.columns).unionByName(hit.select(*docs.columns))


def owned_documents(docs: DataFrame) -> DataFrame:
    """Documents with their ``source`` as owner; its texts in one language stand for one repository."""
    repo = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return source(docs, owner=F.col("source").cast("string"), repo=repo)


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    return restore_id(scan(owned_documents(docs_table(spark, sf_dir))))
