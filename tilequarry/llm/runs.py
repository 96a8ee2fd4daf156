"""Periodic runs of words: maximal stretches that repeat a period, by the algorithm of Kolpakov and Kucherov.

A run is a stretch of consecutive words that has a smallest period q, is at least LEAST periods and LEAST_WORDS words long,
and that no neighbouring word extends. The words of a text are numbered and cut at words too rare to be in any run; each
piece goes through the algorithm: its suffix automaton gives the Lempel-Ziv factors; Main's algorithm finds, from extension
lengths around each border between factors, the runs that touch it; a run strictly inside a factor is the copy of one inside
the factor's earlier occurrence. Time and memory of a text grow with its number of words (and of runs).

The cut loses nothing: each word of a run occurs once in every whole period, so LEAST times at least. A word that occurs
less often in its piece is in no run and extends none, and what is left on its sides holds all runs.

Defined results: a null, empty or blank text has no words and no runs; repeated rows and null doc_ids keep a row each; other
columns are ignored. The collapsed text is the words that no run holds behind its first period, joined by single spaces.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilequarry.llm.common import arrow_map, documents

#: Words are what stands between ASCII blanks.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST, LEAST_WORDS = 4, 6
#: How often a piece is cut again. Cutting only saves time; a hostile text could have a few words cut off each time.
ROUNDS = 8


class Automaton:
    """The suffix automaton of a sequence, with the end of the first occurrence of each state's substrings."""

    def __init__(self, word: Sequence[int]):
        step: list[dict[int, int]] = [{}]
        link, length, first = [-1], [0], [-1]
        last = 0
        for at, c in enumerate(word):
            new = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(at)
            p = last
            while p != -1 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p != -1:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(step)
                    step.append(step[q].copy())
                    link.append(link[q])
                    length.append(length[p] + 1)
                    first.append(first[q])
                    while p != -1 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.step, self.first = step, first


def factors(word: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, end, earlier start) of the Lempel-Ziv factors: the longest stretch that also begins earlier, else one new word, -1."""
    automaton, n = Automaton(word), len(word)
    step, first = automaton.step, automaton.first
    out, at = [], 0
    while at < n:
        state, end, earlier = 0, at, -1
        while end < n:
            state = step[state][word[end]]
            begins = first[state] - (end - at)
            if begins >= at:
                break
            earlier, end = begins, end + 1
        end = max(end, at + 1)
        out.append((at, end, earlier))
        at = end
    return out


def extensions(word: Sequence[int]) -> list[int]:
    """For each place, how many words from there on equal the beginning."""
    n = len(word)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and word[k] == word[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def touching(word: Sequence[int], low: int, at: int, end: int, most: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of stretches in word[low:end] that touch the border `at`, have a period up to most and least periods or more."""
    before, behind, out = word[low:at][::-1], word[at:end], []
    m, n = len(behind), len(before)
    # Extensions of places around the border: to the right against word[at:], to the left against word[:at].
    forward, backward = extensions(behind), extensions(before)
    across = extensions([*behind, -2, *word[max(low, at - most) : end]])[m + 1 :] if n else []
    into = extensions([*before, -2, *word[low : min(end, at + most)][::-1]])[n + 1 :] if m else []
    for p in range(1, min(most, m) + 1):  # one whole period stands behind the border
        right = forward[p] if p < m else 0
        left = min(into[min(end, at + most) - at - p], n) if n else 0
        if left + right >= (least - 1) * p:
            out.append((at - left, at + p + right, p))
    for p in range(1, min(most, n) + 1):  # one whole period stands before the border
        left = backward[p] if p < n else 0
        right = min(across[at - max(low, at - most) - p], m) if m else 0
        if left + right >= (least - 1) * p:
            out.append((at - p - left, at + right, p))
    return out


def all_runs(word: Sequence[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of every run of least periods or more; the words are numbers from 0."""
    word = [*word, -1]  # an end of its own: a run at the end touches a border
    n, found = len(word), {}
    by_start: dict[int, list[tuple[int, int]]] = {}

    def put(start: int, end: int, period: int) -> None:
        if found.get((start, end), n) > period:
            if (start, end) in found:
                by_start[start].remove((end, found[start, end]))
            found[start, end] = period
            by_start.setdefault(start, []).append((end, period))

    previous = 0
    for at, end, earlier in factors(word):
        # A run that ends in this factor and begins before it has a period under (previous + own) / (least - 1), or else the
        # factor before would have been longer; and it begins less than a period before that factor.
        most = (previous + end - at) // (least - 1) + 1
        low = max(0, at - previous - most)
        for a, b, p in touching(word, low, at, end, most, least):
            if (a == 0 or word[a - 1] != word[a - 1 + p]) and (b == n or word[b] != word[b - p]):
                put(a, b, p)
        if earlier >= 0 and end - at > least:
            shift = at - earlier
            for a in range(earlier + 1, end - shift - least):
                for b, p in tuple(by_start.get(a, ())):
                    if b + shift < end:
                        put(a + shift, b + shift, p)
        previous = end - at
    return sorted((a, b, p) for (a, b), p in found.items())


def pieces(words: Sequence[str], least: int = LEAST, shortest: int = LEAST_WORDS) -> list[tuple[int, list[str]]]:
    """(first word's number, words) of the stretches that can hold runs: words that occur less than least times are cut out."""
    waiting, done = [(0, words, 0)] if words else [], []
    while waiting:
        start, part, cuts = waiting.pop()
        counts = Counter(part)
        if cuts == ROUNDS or min(counts.values()) >= least:
            done.append((start, part))
            continue
        at = start
        for frequent, group in groupby(part, key=lambda w: counts[w] >= least):
            stretch = list(group)
            if frequent and len(stretch) >= shortest:
                waiting.append((at, stretch, cuts + 1))
            at += len(stretch)
    return sorted(done)


def word_runs(words: Sequence[str], least: int = LEAST, shortest: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the runs, by start, then period."""
    out = []
    for start, part in pieces(words, least, shortest):
        numbers: dict[str, int] = {}
        out += [(start + a, b - a, p) for a, b, p in all_runs([numbers.setdefault(w, len(numbers)) for w in part], least) if b - a >= shortest]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: Sequence[str], runs: Sequence[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds behind its first period."""
    out, at = [], 0
    for start, end in sorted((s + p, s + n) for s, n, p in runs):
        if end > at:
            out += words[at : max(at, start)]
            at = end
    return [*out, *words[at:]]


def find(docs: DataFrame, *, least: int = LEAST, shortest: int = LEAST_WORDS) -> DataFrame:
    """doc_id, runs array<struct<start, length, period>> (word numbers, by start, then period), text: the collapsed text."""

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": batch.column("doc_id"), "runs": [], "text": []}
            for text in batch.column("text"):
                words = WORD.findall(text.as_py() or "")
                runs = word_runs(words, least, shortest)
                out["runs"].append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                out["text"].append(" ".join(collapsed(words, runs)))
            return out

        return f

    return arrow_map(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, text string")


def looped(doc_id: int | None, words: list[str]) -> list[str]:
    """The words of a document, with a periodic tail where its id's checksum says so; a null id has none."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[: n - a]


def digests(docs: DataFrame, change: Callable[[int | None, list[str]], list[str]] = looped) -> DataFrame:
    """doc_id, n_runs; of the longest run start, length, period, exponent_milli; runs_sha256, collapsed_sha256. change: doc_id and words to the words searched."""

    def make():
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

        def f(batch: pa.RecordBatch) -> dict:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = change(doc_id, WORD.findall(text.as_py() or ""))
                runs = word_runs(words)
                start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                rows.append((doc_id, len(runs), start, length, period, None if period is None else 1000 * length // period, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(collapsed(words, runs)))))
            names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
            return dict(zip(names, zip(*rows, strict=True), strict=True))

        return f

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
