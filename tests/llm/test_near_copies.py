"""Near copies by SimHash against all pairs, and edited copies in the pipeline's stage."""

import random

import numpy as np
import pytest

from geoloom.llm import near_copies


def shingles(t):
    w = (t or "").lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else {()}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute(sets, least):
    """Components over all pairs of at least this similarity."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(sets))}


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[at : at + (kind != 0)] = [] if kind == 2 else [f"new{rng.randrange(10**6)}"]
    return " ".join(words)


def corpus(rng):
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(60, 200))] for _ in range(14)]
    texts = [None, "", "  \n", "a", "A", "a b c", "a b c d e f"]
    texts += [edited(rng, b, rng.randint(0, 5)) for b in base for _ in range(8)]
    texts += [edited(rng, base[0], rng.randint(0, 9)) for _ in range(60)]
    passage = " ".join(base[1])
    return texts + [passage + " " + " ".join(f"o{i}x{k}" for k in range(rng.randint(0, 90))) for i in range(60)]


@pytest.mark.parametrize("dense, block, bound", [(2, 16, 10**6), (3, 256, 0), (10**6, 256, 10**6)])
def test_similar_texts_are_linked(spark, dense, block, bound):
    texts = corpus(random.Random(7))
    sets = [*map(shingles, texts)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, node int")
    got = {r.doc_id: r.component_id for r in near_copies.similar_components(frame, dense=dense, block=block, bound=bound).collect()}
    wanted, close = brute(sets, 0.8), brute(sets, 0.9)
    # No link below the limit; none lost well above it, and few at it.
    assert len(got) == len(texts) and all(wanted[i] == wanted[got[i]] for i in got)
    assert all(got[i] == got[close[i]] for i in got)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.95 * len(pairs)


def test_blocks_find_what_the_first_comparison_leaves(spark):
    """Two families that one value holds, linked by one pair only."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    chain = [list(base)]
    for k in range(14):
        chain.append([*chain[-1][20:], *(f"c{k}x{i}" for i in range(20))])
    texts = [" ".join(edited(rng, c, 1).split()) for c in chain for _ in range(6)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = {r.component_id for r in near_copies.similar_components(frame, dense=2, block=8).collect()}
    wanted = set(brute([*map(shingles, texts)], 0.8).values())
    assert wanted <= roots and len(roots) <= len(wanted) + 1


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert near_copies.similar_components(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "A b"), (None, "alone"), (7, None), (6, " ")], schema)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in near_copies.similar_components(rows).collect())
    assert got == [(-1, -1), (-1, 5), (5, 5), (5, 5), (6, 6), (7, 6)]


def test_wide_prints_and_keys():
    plan = near_copies.Plan(100_000)
    found = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 1000))
    print_ = near_copies.wide_print(found, plan.words)
    ones = np.zeros(64 * plan.words)
    for k in range(plan.words):
        h = (found.view(np.uint64) ^ np.uint64((k + 1) * 0xD6E8FEB86659FD93 % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
        for b in range(64):
            ones[64 * k + b] = (h >> np.uint64(b) & np.uint64(1)).sum()
    assert [int(print_[k // 64].view(np.uint64) >> np.uint64(k % 64)) & 1 for k in range(len(ones))] == (2 * ones > len(found)).astype(int).tolist()
    # Of two values that differ in one bit, exactly one has the other in its ball.
    keys = plan.keys(print_)
    other = keys.copy()
    other[3] ^= 1 << 5
    assert (other[3] in plan.ball(keys)) != (keys[3] in plan.ball(other))
    assert len(keys) == plan.tables and 64 * plan.words >= plan.tables * plan.width


def test_stage_drops_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(8)
    words = [f"v{rng.randrange(900)}" for _ in range(200)]
    texts = [" ".join(words), *(edited(rng, words, 4) for _ in range(30)), " ".join(words[:100]), " ".join(reversed(words))]
    sets = [*map(shingles, texts)]
    assert all(jaccard(sets[0], s) >= 0.8 for s in sets[1:31])
    frame = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    kept = sorted(r.doc_id if r.doc_id is not None else -1 for r in corpus_pipeline.near_stage(spark, frame, "").collect())
    assert kept == [-1, 0, 31, 32]


def test_line_stage_keeps_what_a_document_has_of_its_own(spark):
    import corpus_pipeline

    passage = " ".join(f"common{k}x{chr(97 + k % 26)}" for k in range(60)).replace("0", "o")
    texts = [f"{passage}\nfirst own words of ten or more tokens stand here in full", f"{passage}\nsecond has less", passage, f"{passage}\n\t\n", "", " \n"]
    frame = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.line_stage(spark, frame, "").collect()}
    assert {i: r.text for i, r in got.items()} == {0: texts[0], 1: "second has less", 4: "", 5: " \n"}
    assert got[1].n_chars == len("second has less")
