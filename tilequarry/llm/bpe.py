"""Byte-level BPE: encoding and decoding over Arrow batches with the tokenizers library.

The rank file gives the vocabulary; the merges follow from the ranks (the last merge of a token joins the two parts into
which the lower ranks alone reduce it). The tokenizer sees each byte as a printable character (the byte-to-character
mapping); decoding goes from ids straight to bytes, so that characters split between tokens come out whole.

Defined results: a null or empty text has no tokens; ids that aren't in the table raise KeyError on decoding; repeated
rows and null ids of documents give a row each; columns other than those named are not looked at. Texts of any length
are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilequarry.llm.common import arrow_map, documents, null_to_empty

RANKS = "byte_bpe_50k.tiktoken"


def byte_characters() -> list[str]:
    """The printable character of each byte: itself if it is printable in Latin-1, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    keep = set(shown)
    return [chr(b) if b in keep else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair whose merge makes each longer token, by rank."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def tokenizer_json(path: str) -> str:
    """The definition of a tokenizer of single matches of the pattern, for Tokenizer.from_str on the executors."""
    chars, ranks = byte_characters(), read_ranks(path)
    show = lambda token: "".join(chars[b] for b in token)
    as_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps(
        {
            "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None,
            "pre_tokenizer": as_bytes,
            "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
                      "vocab": {show(t): r for t, r in ranks.items()}, "merges": [[show(a), show(b)] for a, b in merges_of(ranks)]},
        }
    )


class ByteBpe:
    """Encoder and decoder of one process.

    A text is cut before each space that stands alone between two other characters (no match of the pattern goes over
    such a cut), a part is split by the pattern, and each match is encoded by itself. Parts and matches recur (most are
    words), so that the ids of those seen lately are kept, CACHE of them at most between batches: half of it since the last
    change and as many from before, of which those not used again go at the next change. Those of over LONG characters go at
    once, and so does the match that is all of a word, as the word is kept. The library gets the new matches of a batch by
    TOGETHER, as its own results are large: memory is bounded. A text with a space at an end or beside other white
    space, or with white space but spaces and line feeds, is split by the pattern as a whole.
    """

    CACHE = 200_000
    TOGETHER = 2_000
    #: Characters of what is kept, at most; longer matches are encoded each time.
    LONG = 64

    def __init__(self, definition: str, pattern: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.pieces = regex.compile(pattern).findall
        self.rare_space = re.compile(r"[^\S \n]").search
        self.words: dict[str, bytes] = {}  # of a space and the word
        self.matches: dict[str, bytes] = {}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        back = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = self.tokenizer.get_vocab()
        table: list[bytes] = [b""] * (1 + max(vocabulary.values()))
        for token, rank in vocabulary.items():
            table[rank] = bytes(back[c] for c in token)
        self.lengths = np.array([len(t) for t in table], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(table), dtype=np.uint8)

    def cut(self, text: str) -> tuple[str, list[str]]:
        """What the pattern is to split, and the words that follow, each after a space."""
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or self.rare_space(text):
            return text, []
        head, *words = text.split(" ")
        return head, words

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if len(self.words) + len(self.matches) > self.CACHE // 2:
            self.old, self.words, self.matches = (self.words, self.matches), {}, {}
        words, matches, (old_words, old_matches) = self.words, self.matches, self.old
        parts = [self.cut(t) for t in texts]
        new = []
        for w in {w for _, p in parts for w in p if w not in words}:
            if w in old_words:
                words[w] = old_words[w]
            else:
                new.append(w)
        heads, tails = [self.pieces(h) for h, _ in parts], [self.pieces(" " + w) for w in new]
        fresh = []
        for x in {x for pieces in (*heads, *tails) for x in pieces if x not in matches}:
            if x in old_matches:
                matches[x] = old_matches[x]
            else:
                fresh.append(x)
        for at in range(0, len(fresh), self.TOGETHER):
            some = fresh[at : at + self.TOGETHER]
            for x, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                matches[x] = np.array(e.ids, dtype="<u4").tobytes()
        of = matches.__getitem__
        words.update((w, b"".join(map(of, tail))) for w, tail in zip(new, tails, strict=True))
        out = [b"".join([*map(of, head), *map(words.__getitem__, p)]) for head, (_, p) in zip(heads, parts, strict=True)]
        for w, tail in zip(new, tails, strict=True):
            if len(tail) == 1:
                matches.pop(tail[0], None)
        for kept, found in ((words, new), (matches, fresh)):
            for x in found:
                if len(x) > self.LONG:
                    kept.pop(x, None)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, dtype="<u4") for x in self.encode_bytes(texts)]

    def decode_bytes(self, ids) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.lengths):
            raise KeyError("an id outside the table")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lengths), lengths)].tobytes()

    def offsets(self, text: str, ids: np.ndarray) -> list[tuple[int, int]]:
        """Each token's range of code points: from the character its first byte lies in to behind that of its last byte."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        char_of = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        return list(zip(char_of[starts].tolist(), (char_of[ends - 1] + 1).tolist(), strict=True)) if len(ids) else []


def definition(spark: SparkSession, path: str | None = None, pattern: str | None = None):
    """The broadcast definition. Its size is that of the vocabulary file, not of the data."""
    import public_tokenizers

    return spark.sparkContext.broadcast((tokenizer_json(path or public_tokenizers.path(RANKS)), pattern or public_tokenizers.PATTERN))


def encode(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), offsets: bool = False, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """keep columns, token_ids array<int>, and with offsets=True starts and ends array<int> in code points."""
    shared = definition(docs.sparkSession, path, pattern)
    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", token_ids array<int>" + ", starts array<int>, ends array<int>" * offsets

    def make():
        bpe = ByteBpe(*shared.value)

        def f(batch: pa.RecordBatch) -> dict:
            texts = null_to_empty(batch.column("text__"))
            ids = bpe.encode(texts)
            out = {c: batch.column(c) for c in keep} | {"token_ids": ids}
            if offsets:
                at = [bpe.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
                out |= {"starts": [[a for a, _ in x] for x in at], "ends": [[b for _, b in x] for x in at]}
            return out

        return f

    return arrow_map(docs.select(*keep, docs[text].alias("text__")), make, schema)


def decode(tokens: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), path: str | None = None, pattern: str | None = None) -> DataFrame:
    """keep columns and text: token_ids decoded; bytes that aren't UTF-8 become U+FFFD. Null ids: the empty text."""
    shared = definition(tokens.sparkSession, path, pattern)
    kept = tokens.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", text string"

    def make():
        bpe = ByteBpe(*shared.value)
        return lambda batch: {c: batch.column(c) for c in keep} | {"text": [bpe.decode_bytes(i or []).decode(errors="replace") for i in batch.column("token_ids").to_pylist()]}

    return arrow_map(tokens.select(*keep, "token_ids"), make, schema)


def encode_checked(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """keep columns, token_ids array<int>, n_tokens, round_trip: whether the decoded bytes are the text's."""
    shared = definition(docs.sparkSession, **options)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", token_ids array<int>, n_tokens long, round_trip boolean"

    def make():
        bpe = ByteBpe(*shared.value)

        def f(batch: pa.RecordBatch) -> dict:
            texts = null_to_empty(batch.column("text__"))
            ids = bpe.encode(texts)
            same = [bpe.decode_bytes(i) == t.encode() for t, i in zip(texts, ids, strict=True)]
            return {c: batch.column(c) for c in keep} | {"token_ids": ids, "n_tokens": [len(i) for i in ids], "round_trip": same}

        return f

    return arrow_map(docs.select(*keep, docs["text"].alias("text__")), make, schema)


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 of the ids as little-endian 32-bit integers, decoded_sha256 of the decoded bytes."""
    shared = definition(docs.sparkSession, **options)

    def make():
        bpe = ByteBpe(*shared.value)

        def f(batch: pa.RecordBatch) -> dict:
            ids = bpe.encode(null_to_empty(batch.column("text")))
            return {
                "doc_id": batch.column("doc_id"),
                "n_tokens": [len(i) for i in ids],
                "ids_sha256": [hashlib.sha256(i.tobytes()).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode_bytes(i)).hexdigest() for i in ids],
            }

        return f

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
