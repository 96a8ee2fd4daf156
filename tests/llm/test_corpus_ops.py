"""Operators on whole corpora against brute force: line dedup, embeddings, mixing, SimHash, components, the pipeline."""

import random
import re

import numpy as np
import pytest

from tests.llm.conftest import AWKWARD
from tilequarry.llm import common, components, embedding_dedup, line_dedup, mixing, near_copies, simhash


def awkward(rows):
    return rows(AWKWARD, ids=[1, 2, None, 4, 5, 6, 7, 7], sources=["a", None, "b", "a", "a", "a", "c", "c"])


# line dedup


def brute_lines(texts, least):
    """Deleted lines of each text: those within a run of `least` words or more that stands earlier, without overlap."""
    seen, gone = {}, []
    for d, t in enumerate(texts):
        lines = [(i, x.strip(" \t\n\r\x0b\x0c")) for i, x in enumerate(t.split("\n"))]
        lines = [(i, x) for i, x in lines if x]
        out = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x for _, x in lines[a : b + 1])
                if sum(len(x.split()) for x in run) >= least:
                    before = seen.setdefault(run, (d, lines[a][0], lines[b][0]))
                    if before[0] < d or before[2] < lines[a][0]:
                        out |= set(range(lines[a][0], lines[b][0] + 1))
        gone.append(sorted(out))
    return gone


def test_line_dedup_keeps_a_first_copy_whole(rows):
    line = " ".join(["same"] * 10)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(rows(["\n".join([line] * 12), "\n".join([line] * 5)])).collect()}
    assert got[0] == "\n".join([line] * 5) and got[1] == ""


def test_line_dedup_ships_minima_only(rows):
    """Minima are fewer than lines, and all that a repeated run needs: another choice of line finds no common one."""
    rng = random.Random(7)
    run = "\n".join(" ".join(f"w{rng.randrange(500)}" for _ in range(6)) for _ in range(30))
    docs = rows(["x\n" * 3 + run, "a b c\n" + run + "\nd e"])
    anchors = line_dedup._anchors(docs, 50).collect()
    lines = 30 + 30 + 5
    assert len(anchors) < lines / 2 and all(len(r["first"]) == len(r["last"]) == len(r["content"]) > 0 for r in anchors)
    marks = [{r["mark"] for r in anchors if r["no"] == n} for n in (0, 1)]
    assert marks[0] & marks[1]
    shifted = [r["removed__"] for r in line_dedup.dedup(docs).orderBy("doc_id").collect()]
    assert shifted == [[], list(range(1, 31))]


def test_line_dedup_hot_runs_and_names(rows):
    """One passage in every document, and columns named like working ones."""
    passage = "\n".join(f"passage line {i} of these many words here" for i in range(9))
    texts = [f"own {i} line\n{passage}\nend {i}" for i in range(200)]
    docs = rows(texts).withColumnsRenamed({"key": "lines__"}).selectExpr("*", "1 no__", "2 tie__", "3 starts__", "4 ends__", "5 removed__", "6 content")
    got = line_dedup.dedup(docs).collect()
    assert [len(r["removed__"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [0] + [9] * 199
    assert all((r["no__"], r["tie__"], r["starts__"], r["ends__"], r["content"], r["lines__"]) == (1, 2, 3, 4, 6, "1") for r in got)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_line_dedup(rows, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(14)]
    texts = ["\n".join(rng.choice([*pool, "", "  " + pool[0]]) for _ in range(rng.randint(1, 14))) for _ in range(24)]
    got = {r["doc_id"]: r for r in line_dedup.dedup(rows(texts), min_words=9).collect()}
    for i, want in enumerate(brute_lines(texts, 9)):
        assert got[i]["removed__"] == want
        assert got[i]["text"] == ("\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in want) if want else texts[i])


def test_line_dedup_awkward(rows):
    got = line_dedup.dedup(awkward(rows)).collect()
    assert len(got) == 8 and [r["text"] for r in got if r["doc_id"] == 1] == [None] and line_dedup.dedup(rows([])).count() == 0
    long = "\n".join(f"line {i} of a long text" for i in range(3000))
    again = {r["doc_id"]: r["text"] for r in line_dedup.dedup(rows(["start\n" + long, "other\n" + long, "own " * 60])).collect()}
    assert again[0] == "start\n" + long and again[1] == "other" and again[2] == "own " * 60


def test_joins_with_texts_beyond_the_broadcast_bound(rows, monkeypatch):
    """Small tables of deletions and ids are broadcast, larger ones shuffled; results are the same."""
    from tilequarry.llm import common

    texts = ["\n".join(f"line {k} of some words that stand in many texts" for k in range(8)) + f"\nend {i // 2}" for i in range(12)] + [None, ""]
    docs = rows(texts)
    small = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup(docs).collect()), sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert "Broadcast" not in common.bounded(docs, 1)._jdf.queryExecution().toString()
    assert small == (sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup(docs).collect()), sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()))


# embeddings


def brute_embeddings(vectors, limit):
    n = len(vectors)
    sound = [v is not None and la is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, la in vectors]
    links = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            if sound[i] and sound[j] and vectors[i][2] == vectors[j][2] and len(vectors[i][1]) == len(vectors[j][1]):
                a, b = np.array(vectors[i][1], dtype=np.float32).astype(float), np.array(vectors[j][1], dtype=np.float32).astype(float)
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= limit:
                    links[i].add(j)
                    links[j].add(i)
    out = {}
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[vectors[i][0]] = (len(links[i]), min(vectors[j][0] for j in seen))
    return out


@pytest.mark.parametrize("block", [7, 1024])
def test_embeddings(spark, block):
    rng = np.random.default_rng(3)
    vectors = []
    for c in range(12):
        base = rng.normal(size=16)
        for _ in range(9):
            vectors.append((base + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.3])).tolist())
    vectors = [(100 + i, v, i % 3 if i % 17 else None) for i, v in enumerate(vectors)]
    vectors += [(i, vectors[0][1], 1) for i in range(5)] + [(50, None, 1), (51, [], 1), (52, [0.0] * 16, 1), (53, [float("nan")] * 16, 1), (54, [None] + [1.0] * 15, 1), (55, [1.0, 2.0], 1), (56, [2.0, 4.0], 1), (57, [float("inf")] * 16, 1)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(frame, block=block).collect()}
    assert got == brute_embeddings(vectors, 0.98)
    assert embedding_dedup.near_duplicates(frame.where("false")).count() == 0


def test_error_bound():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 64))
    x = np.concatenate((x, x + rng.normal(size=x.shape) * 0.14))
    q = embedding_dedup.Quantised(x)
    true = (x / q.norm[:, None]) @ (x / q.norm[:, None]).T
    guess = (q.q.astype(float) * q.scale[:, None]) @ (q.q.astype(float) * q.scale[:, None]).T
    bound = np.outer(q.kept + q.lost, q.kept + q.lost) - np.outer(q.kept, q.kept)
    assert (np.abs(true - guess) <= bound + 1e-12).all() and bound.max() < 0.05
    i, j = embedding_dedup.tile_links(q, q, 0.98)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(a.tolist() for a in np.nonzero(true >= 0.98)), strict=True))


# mixing


def test_mixing(rows):
    rng = random.Random(0)
    texts = [" ".join(["w"] * rng.randint(0, 60)) for _ in range(600)] + [None, ""]
    sources = [rng.choice(["a", "b", "c", "d", None, "e"]) if i % 3 else "a" for i in range(602)]
    got = mixing.mix(rows(texts, sources=sources)).collect()
    size = {s: sum(len((t or "").split()) for t, x in zip(texts, sources, strict=True) if x == s) for s in set(sources)}
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
        open_ -= full
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
    taken = dict.fromkeys(order, 0)
    for r in got:
        s = sources[r["doc_id"]]
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 60
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(rows(texts, sources=sources)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    kept = mixing.take(rows(texts, sources=sources))
    assert kept.columns == rows(texts).columns and kept.count() == sum(r["copies"] for r in got)
    assert mixing.mix(awkward(rows)).count() == 8 and mixing.mix(rows([])).count() == 0


def test_mixing_ranks_by_pareto_keys(rows):
    """Against the definition: rates by bisection, keys in exact fractions, the prefix nearest to the target."""
    import hashlib
    from fractions import Fraction

    rng = random.Random(5)
    texts = [" ".join(["w"] * rng.choice([1, 3, 9, 40, 90])) for _ in range(500)]
    sources = [rng.choice(["a", "a", "a", "b", "c"]) for _ in texts]
    got = {r["doc_id"]: r for r in mixing.mix(rows(texts, sources=sources)).collect()}
    unequal = 0
    for s in "abc":
        own = [i for i, x in enumerate(sources) if x == s]
        size = {i: len(texts[i].split()) for i in own}
        odds = {i: mixing.ODDS + size[i].bit_length() for i in own}
        target, low, high = got[own[0]]["target"], 0.0, 1.0
        for _ in range(200):
            rate = (low + high) / 2
            low, high = (rate, high) if sum(min(2, rate * odds[i]) * size[i] for i in own) < target else (low, rate)
        copies = {i: min(2, high * odds[i]) for i in own}
        if min(copies.values()) == 2:
            assert all(got[i]["copies"] == 2 for i in own)
            continue
        whole = {i: int(copies[i]) for i in own}
        unequal += len({round(copies[i] - whole[i], 6) for i in own}) > 1
        keys = {}
        for i in own:
            u = (Fraction(int(hashlib.md5(f"mix-1|{i}".encode()).hexdigest()[:13], 16)) + Fraction(1, 2)) / 2**52
            p = Fraction(copies[i] - whole[i])
            keys[i] = (u / (1 - u)) / (p / (1 - p))
        room, taken, best = target - sum(whole[i] * size[i] for i in own), 0, set()
        for i in sorted(own, key=keys.get):
            if taken + size[i] > room and taken + size[i] - room >= room - taken:
                break
            taken += size[i]
            best.add(i)
            if taken > room:
                break
        assert {i for i in own if got[i]["copies"] > whole[i]} == best
        # Ranking by u alone, as if probabilities were equal, takes others.
        assert sorted(own, key=keys.get)[: len(best)] != sorted(own, key=lambda i: hashlib.md5(f"mix-1|{i}".encode()).hexdigest()[:13])[: len(best)]
    assert unequal


def test_mixing_keeps_clashing_columns(rows):
    docs = rows(["a b c"] * 30).selectExpr("*", "1 key__", "2 weight__", "3 copies", "4 size", "5 bound__", "6 target", "7 rank")
    got = mixing.take(docs).collect()
    assert got and all(tuple(r)[6:] == (1, 2, 3, 4, 5, 6, 7) for r in got)


# SimHash


def test_simhash_fingerprint():
    import xxhash

    def brute(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
        if not words:
            return 0
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for t in ("", "a", "A b", "É é Z z y", "one two three", "a b c d " * 40, "\x1c x \x85 y", " lead\x0btrail\x0c"):
        assert simhash.fingerprint(t) == brute(t)


def test_keys_meet_within_three_bits():
    golay, rng = simhash.Golay(), np.random.default_rng(0)
    assert (golay.index >= 0).all()
    x = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, int(rng.integers(0, 4)), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    (ra, ka), (rb, kb) = simhash.search_keys(golay, x), simhash.search_keys(golay, y)
    pairs = set(zip(ra.tolist(), ka.tolist(), strict=True)) & set(zip(rb.tolist(), kb.tolist(), strict=True))
    assert {r for r, _ in pairs} == set(range(len(x)))


@pytest.mark.parametrize("block", [3, 512])
def test_links_connect_all(spark, block):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 30)]
    for _ in range(120):
        f = fps[int(rng.integers(0, len(fps)))]
        for b in rng.choice(63, int(rng.integers(1, 5)), replace=False):
            f ^= 1 << int(b)
        fps.append(f)
    fps = sorted(set(fps))
    got = {r["node"]: r["component"] for r in components.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), block=block)).collect()}
    u = np.array(fps, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u) <= 3
    for i, f in enumerate(fps):
        seen, todo = {i}, [i]
        while todo:
            for j in set(np.nonzero(near[todo.pop()])[0].tolist()) - seen:
                seen.add(j)
                todo.append(j)
        assert got.get(f, f) == min(fps[j] for j in seen)


def test_keys_are_never_broadcast(spark, tmp_path):
    """A fingerprint has 26 keys, a set as many bands; the planner's estimate is that of one, so both joins are told to shuffle."""
    spark.createDataFrame([(i,) for i in range(50)], "fp long").write.parquet(str(tmp_path / "fps"))
    found = simhash.links(spark.read.parquet(str(tmp_path / "fps")))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    groups = spark.createDataFrame([(i, i, i, 1, [7], [0, 0, 0]) for i in range(9)], "sid long, c long, tie long, n int, keys array<long>, bits array<long>")
    with common.Scratch(spark) as scratch:
        tiles = near_copies._tiles(groups, scratch, 256)
        assert "BroadcastHashJoin" not in tiles._jdf.queryExecution().executedPlan().toString()
        assert [len(r["ones"]) for r in tiles.collect()] == [9]


def test_simhash_groups(rows):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [base, base + " extra", base.upper(), "quite another text with words of its own", None, "", base]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(rows(texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 0}
    kept = simhash.keep_one(rows(texts))
    assert kept.columns == rows(texts).columns and {r["doc_id"] for r in kept.collect()} == {0, 3, 4}
    assert simhash.near_duplicates(awkward(rows)).count() == 8 and simhash.near_duplicates(rows([])).count() == 0


@pytest.mark.parametrize("block", [4, 256])
def test_pipeline_near_copies(spark, rows, block):
    """The stage against brute force: every pair of 5-word Jaccard 0.8 is linked, however far the fingerprints are."""
    import corpus_pipeline

    rng = random.Random(9)
    line = " ".join(f"common{i}" for i in range(12))
    texts = []
    for g in range(25):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randrange(20, 150))]
        texts.append(" ".join([*base, line]))
        for _ in range(rng.randrange(4)):
            words = list(base)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join([*words, line]))
    texts += ["", None, "short one", texts[3]]
    cut5 = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set()
    sets = [cut5(t) for t in texts]
    fps = [simhash.fingerprint(t) for t in texts]
    parent, far = list(range(len(texts))), 0

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            close, alike = (fps[i] ^ fps[j]).bit_count() <= 3, 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            far += alike and not close
            if close or alike:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(rows(texts), block=block).collect()}
    assert far > 5 and got == {i: find(i) for i in range(len(texts))}
    kept = corpus_pipeline.near_dedup(spark, rows(texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))
    assert near_copies.near_copies(awkward(rows)).count() == 8 and near_copies.near_copies(rows([])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(5, 5)]
    parent = list(range(300))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tilequarry.llm import bpe

    words = "the of and house with that water this river over under where when".split()
    rng = random.Random(4)
    passage = "\n".join(" ".join(rng.choice(words) for _ in range(20)) for _ in range(4))
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(30)]
    texts[10] += "\n" + passage
    texts[20] += "\n" + passage
    texts[5] = texts[4] + " ends"
    texts.append(None)
    spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        steps[name] = docs
        if name != "byte-level BPE":
            assert docs.columns == before.columns
    clean = {r["doc_id"]: r["text"] for r in steps["line dedup"].collect()}
    assert passage in clean[10] and passage.split("\n")[0] not in clean[20]
    assert steps["SimHash near-dedup"].count() < steps["line dedup"].count()
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.count() == steps["mixing"].count() and final.where("not round_trip").count() == 0
    assert sorted(r["text"] or "" for r in bpe.decode(final).collect()) == sorted(r["text"] or "" for r in steps["mixing"].collect())


def brute_near(texts, ids):
    """Indices that stay: of each group linked by SimHash (3 bits) or 5-word Jaccard 0.8 the smallest id."""
    cut5 = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set()
    sets, fps, head = [cut5(t or "") for t in texts], [simhash.fingerprint(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = head[i], head[j]
                head = [new if h == old else h for h in head]
    least = {h: min(ids[k] for k in range(len(ids)) if head[k] == h) for h in head}
    return [i for i in range(len(texts)) if ids[i] == least[head[i]]]


def test_pipeline_against_brute_force(spark, tmp_path):
    import duckdb
    import pandas as pd
    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from tests.llm.test_text_ops import brute_posteriors
    from tilequarry.llm import bpe

    words = {"en": "the of and house with that water this over under where when", "de": "der die und nicht haus wasser mit schön über auf wo wenn"}
    rng = random.Random(6)
    passage = "\n".join(" ".join(rng.choice(words["en"].split()) for _ in range(18)) for _ in range(4))
    docs = []
    for i in range(60):
        lang = ["en", "en", "de"][i % 3]
        text = " ".join(rng.choice(words[lang].split()) + str(rng.randrange(9)) * (rng.random() < 0.3) for _ in range(rng.randrange(15, 90)))
        text += "\n" + passage if i % 7 == 0 else ""
        docs.append((i, text, lang, "abc"[i % 3], len(text)))
    docs += [(60 + k, docs[k][1].replace(" the ", " that ", 1), "en", "a", 1) for k in (1, 4, 8)]
    docs += [(70, None, "en", None, None), (71, "", "de", "b", 0), (72, "0x91 ## 8812 9", None, "z", 9), (73, docs[2][1], "de", "c", 1)]
    docs = [d + (k,) for k, d in enumerate(docs)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, lines__ int").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [d for d, r in zip(docs, brute_posteriors([(d[1], d[2] and d[2].lower()[:2], None, d[3], None) for d in docs]), strict=True) if r[3]]
    assert 0 < len(docs) - len(kept) < 5
    gone = brute_lines([d[1] or "" for d in kept], 50)
    cleaned = [(d[0], None if d[1] is None else "\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in own), *d[2:]) for d, own in zip(kept, gone, strict=True)]
    assert any(gone)
    unique = [cleaned[i] for i in brute_near([d[1] for d in cleaned], [d[0] for d in cleaned])]
    assert len(unique) < len(cleaned)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": [d[0] for d in unique], "text": pd.Series([d[1] for d in unique], dtype=object), "source": pd.Series([d[3] for d in unique], dtype=object)}))
    copies = {i: taken // max(size, 1) for i, size, _, _, taken in con.execute(mixing.OP8_SQL).fetchall()}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    want = sorted((d[0], coder.encode_ordinary(d[1] or "")) for d in unique for _ in range(copies[d[0]]))
    assert sorted((r["doc_id"], r["token_ids"]) for r in got) == want and all(r["round_trip"] for r in got)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "byte-level BPE" or out.columns == empty.columns)


def test_pipeline_of_nulls_and_repeats(spark, rows):
    """Null ids, null and repeated rows go through each stage, with clashing columns."""
    import corpus_pipeline

    docs = awkward(rows).union(awkward(rows)).selectExpr("*", "1 gone__", "2 key__", "3 no__", "4 stay__")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        docs = docs if name == "byte-level BPE" else spark.createDataFrame(out.collect(), docs.schema)
    assert out.count() == docs.count() > 0 and out.where("not round_trip").count() == 0
