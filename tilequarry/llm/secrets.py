"""Secret scans: pattern findings, and dictionary-primed zstandard novelty for strings no pattern names.

Base kinds are `assign` (a value given to a password, secret, token or key), `access` (access key ids) and `hex` (long hex
runs). The method adds `novel`: a candidate is a string of letters, digits and +/_=.- in a sensitive context (a word such
as secret, auth or bearer shortly before it on its line, in the name it is given to, or before a colon or equals sign at the end of the line above) that mixes letters and digits and overlaps no base span. Its novelty is
what it adds to the compressed size of the code around it: a zstandard compressor primed with a dictionary of identifiers
compresses the surrounding code with and without it, and the difference, per byte of the candidate, must reach a
threshold. Identifiers, repeated words and values that stand elsewhere in the context add next to nothing; keys do.

Defined results: a null or empty text has no findings; repeated rows and null doc_ids keep a row each; other columns are
ignored. Texts are read whole, of any length; the surrounding code of a candidate is CONTEXT characters on either side.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilequarry.llm.common import arrow_map, documents, null_to_empty

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Whole runs of hex digits: a run's first 24 are where the leftmost match begins.
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

SENSITIVE = re.compile(r"(?:secret|token|passw|passphrase|pwd|auth|bearer|credential|private|api|access|signing|client|session|key)", re.IGNORECASE | re.ASCII)
#: How far behind a sensitive word a candidate may begin.
REACH = 80
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.\-]{12,}", re.ASCII)
#: The rest of a name that goes on behind a sensitive word, or begins a candidate, and the sign that gives it its value.
NAME = re.compile(r"[A-Za-z0-9+/_.\-]*=+", re.ASCII)
RUN = re.compile(r"[A-Za-z0-9+/_=.\-]*", re.ASCII)
#: Behind a sensitive word: its value stands on the next line.
NEXT_LINE = re.compile(r"""[A-Za-z0-9_\-]*["']?[ \t]*[:=][ \t]*[>|\\(\[{"']*[ \t]*\r?\n""", re.ASCII)
DIGIT = re.compile(r"[0-9]")
CONTEXT = 400
#: Bytes added for each byte of a candidate, at least.
NOVELTY = 0.55
LEVEL = 3

#: Words that code around credentials is made of.
IDENTIFIERS = """
access account action address admin algorithm allow amount api app application args array async attribute auth authentication
authorization await base batch begin bearer body boolean branch bucket buffer build byte cache call callback certificate
char check class client cloud code column command commit common config configuration connect connection const content
context cookie count create credential credentials current database date debug default define delete description device
dict digest directory document domain double download email enable encode encrypt end endpoint engine entry environment
error event example exception export expire false field file filter final float format from function generate get github
global group handler hash header headers host http https id identifier import include index info init input instance int
integer interface internal item json key keys label language length level library license line link list load local
localhost location log login long main manager map master match message metadata method model module name namespace new
node none null number object offset openssl option options order output package page parameter params parse password path
pattern payload permission placeholder platform plugin port prefix print private process production profile project
properties protected provider proxy public query queue random read redirect refresh region register release remote
request require resource response result return role root route sample schema scope script secret secrets security select
self send server service session set setting settings sha signature size source sql ssh stack standard start state static
status storage store stream string struct sub suffix system table tag target template test text time timeout timestamp
title token tokens tool type undefined update upload uri url use user username users utf value values variable version
view void webhook while window write xml yaml your-key-here changeme example-token xxxxxxxxxxxxxxxx
"""


def novel_dictionary(words: str = IDENTIFIERS) -> bytes:
    """The bytes that prime the compressor: identifiers alone and in the two usual ways to join them."""
    names = words.split()
    joined = [f"{a}_{b}" for a, b in zip(names, names[1:], strict=False)] + [a + b.capitalize() for a, b in zip(names, names[1:], strict=False)]
    return " ".join([*joined, *names, *(n.upper() for n in names), "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"]).encode()


class Novelty:
    """Marginal compressed bytes under a primed compressor."""

    def __init__(self, primer: bytes | None = None):
        import zstandard

        primed = zstandard.ZstdCompressionDict(primer or novel_dictionary(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_dict_id=False).compress

    def of(self, text: str, start: int, end: int) -> float:
        """Bytes that text[start:end] adds to the size of its surroundings, for each of its own."""
        before, own, after = text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + CONTEXT]
        around = (before + after).encode()
        return (len(self.compress((before + own + after).encode())) - len(self.compress(around))) / len(own.encode())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of pattern findings, by start, then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def _mixed(s: str) -> bool:
    """Both letters and digits: not a word, a number or a path of words."""
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty, threshold: float = NOVELTY) -> list[tuple[int, int, str]]:
    out, done = [], 0
    if not DIGIT.search(text):
        return out
    for word in SENSITIVE.finditer(text):
        if word.end() < done:
            continue
        below = NEXT_LINE.match(text, word.end(), word.end() + REACH)
        stop = text.find("\n", below.end() if below else word.end(), word.end() + REACH)
        stop = word.end() + REACH if stop < 0 else stop
        name = NAME.match(text, word.end()) or RUN.match(text, word.end())
        at = max(name.end(), done)
        while m := CANDIDATE.search(text, at):
            if m.start() >= stop:
                break
            at = done = m.end()
            if not _mixed(m[0]) or any(a < m.end() and m.start() < b for a, b, _ in base):
                continue
            if novelty.of(text, m.start(), m.end()) >= threshold:
                out.append((m.start(), m.end(), "novel"))
            elif name := NAME.match(text, m.start(), m.end()):
                at = done = name.end()  # the value alone
        else:
            break  # no candidate in the rest of the text
    return out


def render(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), threshold: float = NOVELTY, primer: bytes | None = None) -> DataFrame:
    """keep columns and findings: array of struct(kind, start, end, novelty), start and end in code points."""
    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", findings array<struct<kind:string,start:int,end:int,novelty:double>>"

    def make():
        novelty = Novelty(primer)

        def f(batch: pa.RecordBatch) -> dict:
            found = []
            for text in null_to_empty(batch.column("text__")):
                base = base_spans(text)
                every = sorted(base + novel_spans(text, base, novelty, threshold), key=_order)
                found.append([{"kind": k, "start": a, "end": b, "novelty": novelty.of(text, a, b)} for a, b, k in every])
            return {c: batch.column(c) for c in keep} | {"findings": found}

        return f

    return arrow_map(docs.select(*keep, docs["text"].alias("text__")), make, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base findings by kind, base_sha256 of their list, and the list of all spans."""

    def make():
        novelty = Novelty()

        def f(batch: pa.RecordBatch) -> dict:
            texts = null_to_empty(batch.column("text"))
            base = [base_spans(t) for t in texts]
            spans = [sorted(b + novel_spans(t, b, novelty), key=_order) for t, b in zip(texts, base, strict=True)]
            counts = {f"n_{k}": [sum(s[2] == k for s in b) for b in base] for k in KINDS[:3]}
            return {"doc_id": batch.column("doc_id"), **counts, "base_sha256": [hashlib.sha256(render(b).encode()).hexdigest() for b in base], "spans": [render(s) for s in spans]}

        return f

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
