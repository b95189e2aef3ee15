"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes shared by every function, spelled out so that Java and Python agree.  Visible ASCII is sorted out by one
# comparison; the rest of the class, which asks for the category of a character, is evaluated for other characters only.
BLANKS = r"\s\x1C-\x1F\x85\p{Z}"
WS = rf"[[^\x21-\x7E]&&[{BLANKS}]]"
WORD = r"\p{L}\p{N}_"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, for fold results that are used several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def between(xs: Column, lo: Column, hi: Column) -> Column:
    """``xs[lo:hi]`` for ``0 <= lo`` and ``hi <= size``, in time of its length (``slice`` in a lambda copies all of ``xs`` each time)."""
    return F.when(hi > lo, F.transform(F.sequence(lo, hi - 1), lambda i: F.get(xs, i))).when(hi <= lo, F.slice(xs, 1, 0))


def strip(c: Column) -> Column:
    """Trim every kind of blank, not only U+0020."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def clean_ws(c: Column) -> Column:
    """T4: collapse blanks and trim."""
    # A single U+0020 stays as it is.
    return F.trim(F.regexp_replace(c, f"[{WS}&&[^ ]]{WS}*+| {WS}++", " "))


def clean_punct(c: Column) -> Column:
    """Tighten blanks around punctuation.

    What becomes of a run of blanks depends on its two neighbours only, and no replacement changes those: one pass removes all such runs.
    """
    c = F.regexp_replace(c, rf'{WS}(?<!{WS}{WS})(?:(?<=[("]{WS}){WS}*+|{WS}*+(?=[,.?!;:%)"]))', "")
    return clean_ws(c)


def detokenise(tokens: Column) -> Column:
    """Tokens to plain text."""
    return clean_punct(F.array_join(tokens, " "))


def space_punct(c: Column) -> Column:
    """Put blanks around every character that is neither word nor blank."""
    return clean_ws(F.regexp_replace(c, f"([[^a-z]&&[^{WORD}{BLANKS}]])", " $1 "))


def truthy(c: Column) -> Column:
    """NULL for the empty string."""
    return F.when(c != "", c)


def first_truthy(*cols: Column, default: Column | None = None) -> Column:
    """The first value that is neither NULL nor empty."""
    args = [truthy(c.cast("string")) for c in cols]
    return F.coalesce(*args, *([default] if default is not None else []))


def _source_parts(source: Column) -> Column:
    return F.split(source, r"\. ", 3)


def strip_prompt(source: Column) -> Column:
    """The text after ``Domain: x. Task prompt. `` (third part, else second, else all)."""
    p = _source_parts(source)
    return F.when(F.size(p) >= 3, strip(F.get(p, F.lit(2)))).when(F.size(p) == 2, strip(F.get(p, F.lit(1)))).otherwise(source)


def source_text(source: Column) -> Column:
    """T7 as the assembly step uses it: third part or everything, untrimmed."""
    p = _source_parts(source)
    return F.when(F.size(p) >= 3, F.get(p, F.lit(2))).otherwise(source)


def prefix_len(source: Column) -> Column:
    """Length of the part T7 removes."""
    p = _source_parts(source)
    n0, n1 = F.length(F.get(p, F.lit(0))), F.length(F.get(p, F.lit(1)))
    return F.when(F.size(p) >= 3, n0 + n1 + 4).when(F.size(p) == 2, n0 + 2).otherwise(F.lit(0))


def slice_span(source: Column, start: Column, end_inclusive: Column) -> Column:
    """T13."""
    return F.substring(source, start + 1, end_inclusive - start + 1)


def result_key(doc_id: Column, dataset: Column, model_type: Column, source: Column) -> Column:
    """T14."""
    return F.concat_ws("::", doc_id, dataset, model_type, F.left(clean_ws(source), F.lit(80)))


def preview(c: Column, n: int = 120) -> Column:
    """T15."""
    return F.left(c, F.lit(n))


def format_offset(start: Column, end: Column) -> Column:
    """T16."""
    return F.when(start.isNotNull() & end.isNotNull(), F.format_string("[%d, %d]", start, end)).otherwise(F.lit("[]"))


def parse_int(c: Column, default: int) -> Column:
    """As a 64-bit number."""
    return F.coalesce(strip(c).try_cast("long"), F.lit(default).cast("long"))


def ae_trigger(pred: Column, compat: bool = False) -> tuple[Column, Column]:
    """Trigger text and type named at the head of an argument-extraction prediction.

    ``compat`` cuts the type at its first colon; the default keeps types such as ``A:B`` whole.
    """
    # Possessive, as Java matches other repetitions of groups by recursion; no cut of the tail could match more.
    tail = r"([^:|]+)" if compat else r"((?:[^:|]++|:(?! ))++)"
    pat = rf"trigger>\s*([^\n]*?)\s*>?=\s*{tail}"
    return strip(F.regexp_extract(pred, pat, 1)), strip(F.regexp_extract(pred, pat, 2))


def one_json(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else; NULL for any other text.

    ``parse_json`` stops after the first value.  Here the text is followed by a mark within a list, so whatever comes behind
    the value, or closes the list early, leaves a list of another shape.
    """
    mark = F.md5(text.cast("binary"))
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]'))), "$", "array<variant>")
    return let(items, lambda x: F.when((F.size(x) == 2) & (F.try_variant_get(F.get(x, F.lit(1)), "$", "string") == mark), F.get(x, F.lit(0))))


# Strings, brackets, marks and scalars; possessive, as Java matches other repetitions of groups by recursion.
_JSON_TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]:,]|[^\s"{}\[\]:,]++|\S'
_CUT = "\x01"


def json_values(text: Column) -> Column:
    """The JSON values a text holds one after the other, as texts; NULL when any of them is no JSON or there is none.

    Two values meet where one token ends a value and the next begins one, without a comma or colon between them.  Inside a value
    that never happens, so a text cut at all such places is well-formed if and only if every piece is.
    """
    tokens = F.regexp_extract_all(text, F.lit(_JSON_TOKEN), F.lit(0))

    def glued(ts):
        def cut(x, i):
            before = F.get(ts, i - 1)
            meets = (i > 0) & ~F.right(before, F.lit(1)).isin("{", "[", ":", ",") & ~F.left(x, F.lit(1)).isin("}", "]", ":", ",")
            return F.when(meets, F.concat(F.lit(_CUT), x)).otherwise(x)
        return F.split(F.array_join(F.transform(ts, cut), ""), _CUT)

    pieces = let(tokens, lambda ts: F.when(F.size(ts) > 0, glued(ts)))
    return let(pieces, lambda ps: F.when(~F.contains(text, F.lit(_CUT)) & F.forall(ps, lambda p: one_json(p).isNotNull()), ps))


def extract_json(text: Column) -> Column:
    """The outermost ``{...}`` of a reply, fences dropped; NULL when there is none or it is not one JSON object."""
    t = F.replace(strip(text), F.lit("```json"), F.lit("```"))
    parts = F.split(t, "```")
    body = F.when(F.size(parts) >= 3, strip(F.get(parts, F.lit(1)))).otherwise(strip(text))
    return let(truthy(F.regexp_extract(body, r"(?s)\{.*\}", 0)), lambda j: F.when(one_json(j).isNotNull(), j))


def ordered_distinct(items: Column) -> Column:
    """Trimmed, blanks dropped, first occurrence kept."""
    return F.array_distinct(F.filter(F.transform(items, strip), lambda x: x != ""))


def normalise_labels(json_list: Column) -> Column:
    """A JSON list of labels to an array; anything else to an empty array."""
    return F.coalesce(ordered_distinct(F.from_json(json_list, "array<string>")), F.array().cast("array<string>"))


def normalise_tuples(json_list: Column, width: int = 2) -> Column:
    """A JSON list of pairs (``width`` 2) or triples (3); members of another kind, short or blank ones dropped."""
    members = F.try_variant_get(F.try_parse_json(json_list), "$", "array<variant>")
    items = F.filter(F.transform(members, lambda m: F.try_variant_get(m, "$", "array<string>")), lambda p: p.isNotNull())
    cut = F.transform(items, lambda p: F.transform(F.slice(p, 1, width), strip))
    ok = F.filter(cut, lambda p: (F.size(p) == width) & ~F.exists(p, lambda x: F.coalesce(x, F.lit("")) == ""))
    return F.coalesce(ok, F.array().cast("array<array<string>>"))


def label_block(title: str, labels: Column) -> Column:
    """T23."""
    return F.concat(F.lit(f"{title}: ["), F.array_join(labels, ", "), F.lit("]"))


def reviewer_slug(c: Column) -> Column:
    """T24."""
    return F.replace(strip(F.coalesce(truthy(c), F.lit("reviewer"))), F.lit(" "), F.lit("_"))
