"""Access to a byte-level BPE vocabulary file, and encoding of very long texts in overlapping chunks.

A tokenizer is opened once per Python worker from a path every executor has; texts go to it in bounded groups.

**Overlap resynchronisation.**  A byte-level BPE tokenizer first cuts the text into pre-tokens, from left to right and without
looking back, then merges inside each.  Encode a chunk that begins at a proven boundary: every pre-token that ends far enough
before the chunk's end is the same as in the whole text.  Encode the next chunk from some characters earlier, at an arbitrary
place: it may start out of step, but once one of its pre-token boundaries falls on a proven boundary of the chunk before,
everything after it is as in the whole text.  So the chunks are spliced at such a common boundary.  If the overlap holds none
(say, one letter repeated a hundred thousand times), the overlap and the chunk are widened and encoded again.
"""

from __future__ import annotations

import os

import numpy as np

GPT_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the split pattern of byte-level BPE
MARGIN = 64  # characters before a chunk's end that are not trusted; longer than any added token and its context
_open: dict[str, object] = {}


def tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path: str | None = None):
    """The tokenizer of a ``.json`` file, without truncation or padding."""
    path = tokenizer_path(path)
    if path not in _open:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _open[path] = t
    return _open[path]


def _encode(tok, text: str):
    """Ids, character ends, and the ends that close a pre-token."""
    e = tok.encode(text, add_special_tokens=False)
    ids = np.array(e.ids, np.uint32)
    ends = np.array([b for _, b in e.offsets], np.int64)
    word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    # Word numbers start again after an added token, so those tokens close one too.
    last = np.ones(len(ids), bool)
    last[:-1] = (word[1:] != word[:-1]) | (word[1:] < 0)
    return ids, ends, last


def encode_long(text: str, tok, chunk: int = 1 << 16, overlap: int = 1 << 10) -> np.ndarray:
    """Ids of the whole text, encoding at most about ``chunk`` characters at a time unless alignment fails."""
    out: list[np.ndarray] = []
    base, n = 0, len(text)        # everything before ``base`` is done; ``base`` is a proven boundary
    size = chunk
    ids, ends, last = _encode(tok, text[:size])
    stop = min(size, n)
    while stop < n:
        step = overlap
        while True:
            begin = max(base, stop - step)
            stop2 = min(n, max(begin + chunk, stop + step))
            ids2, ends2, last2 = _encode(tok, text[begin:stop2])
            proven = ends[last & (ends + base < stop - MARGIN)] + base
            common = np.intersect1d(proven, np.append(ends2[last2], 0) + begin if begin == base else ends2[last2] + begin)
            if len(common) or begin == base:
                break
            step *= 4
        if begin == base:
            # The widened chunk starts at a proven boundary itself, so it replaces the one before.
            ids, ends, last, stop = ids2, ends2, last2, stop2
            continue
        cut = int(common[-1])
        out.append(ids[:int(np.searchsorted(ends + base, cut, "right"))])
        keep = int(np.searchsorted(ends2 + begin, cut, "right"))
        ids, ends, last = ids2[keep:], ends2[keep:] + begin - cut, last2[keep:]
        base, stop = cut, stop2
    return np.concatenate([*out, ids]) if out else ids


def encode_all(texts: list[str], tok, chunk: int = 1 << 16, group: int = 1 << 20):
    """Yield the ids of each text in order, ``group`` characters at a time; longer texts than ``chunk`` by ``encode_long``."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= group):
            size += len(texts[hi])
            hi += 1
        short = [t for t in texts[lo:hi] if len(t) <= chunk]
        got = iter(tok.encode_batch_fast(short, add_special_tokens=False) if short else [])
        for t in texts[lo:hi]:
            yield np.array(next(got).ids, np.uint32) if len(t) <= chunk else encode_long(t, tok, chunk)
        lo = hi


def _byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: visible Latin-1 stands for itself, the rest follows from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def fast_encoder(path: str | None = None):
    """``encode(text) -> ids`` with the same vocabulary and results as ``tokenizer(path)``, several times faster.

    Byte-pair merging by ids needs a plain byte-level file whose merges are numbered in order.  If the file is of another
    kind, if a text holds code points beyond U+0240 (whose classes may differ between Unicode versions), or if the fast
    library gives up on a text, the tokenizer itself encodes it.
    """
    key = "fast:" + tokenizer_path(path)
    if key in _open:
        return _open[key]
    import json
    tok, quick = tokenizer(path), None
    with open(tokenizer_path(path), encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model.get("merges", [])]
    plain = (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
             and not spec.get("normalizer") and all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
             and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]))
    if plain:
        import tiktoken
        byte, special = _byte_of(), {a["content"]: a["id"] for a in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        quick = tiktoken.Encoding("plain", pat_str=GPT_SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if quick is not None and (text.isascii() or max(text) < "\u0240"):
            try:
                return quick.encode_to_numpy(text, allowed_special="all")
            except BaseException as e:  # the library's own panic is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                    raise
        return np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)

    _open[key] = encode
    return encode
