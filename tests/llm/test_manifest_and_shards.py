"""Merkle manifest, k-d tree shards and source divergence, against plain versions and on odd tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from geoloom.llm import divergence, merkle, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, grp string"


def docs(spark, rows, parts=3):
    """rows: (doc_id, text, lang, source, n_chars); the columns node and grp only have names that operators use."""
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS).repartition(parts)


def saved(docs, folder) -> str:
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def sample(n, langs=("en", None, "de", "", "ö"), seed=1):
    words = ["the", "The", "cat", "sät", "über", "x1y", "...", "mat", "on", "日本"]
    return [(i * 3 % 1009, None if i % 17 == 0 else " ".join(words[(i * j * seed) % 7 % len(words)] for j in range(i % 23)), langs[i * i % 7 % len(langs)], None if i % 11 == 0 else f"s{i % 4}", None if i % 5 == 0 else i)
            for i in range(n)]


# Merkle manifest


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, more=0) -> str:
    i, text, lang, source, n = row
    n = None if n is None else n + more
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def plain_tree(nodes, fanout):
    """The last node and, of each leaf, the siblings before and after at every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
        for leaf, k in enumerate(at):
            run = runs[k // fanout]
            paths[leaf].append(("".join(run[: k % fanout]), "".join(run[k % fanout + 1 :])))
            at[leaf] = k // fanout
        nodes = [digest("".join(r)) for r in runs]
    return nodes[0], paths


def plain_manifest(rows, fanout=2):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[lang] = plain_tree([plain_leaf(r) for r in by_lang[lang]], fanout)
    root, tops = plain_tree([trees[x][0] for x in langs], fanout) if langs else (None, [])
    out = []
    for lang, top in zip(langs, tops):
        for r, path in zip(by_lang[lang], trees[lang][1]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            fold = plain_leaf(r, int(tampered))
            for before, after in path + top:
                fold = digest(before + fold + after)
            out.append((r[0], plain_leaf(r), trees[lang][0], root, digest("".join(a + b for a, b in path + top)), fold, fold == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("rows", [
    [], [(5, "a", "en", "s", 1)], sample(40), sample(11, langs=(None,)), [(None, None, None, None, None)] * 3 + [(7, "é" * 9000, "en", "s", 2)],
    [(1, "a", "en", "s", 1)] * 5 + [(1, "b", "en", "s", 1), (2, "", "en", "", 0)],
], ids=["empty", "one", "several", "null_group", "nulls_and_long", "repeated"])
def test_manifest(spark, tmp_path, rows):
    got = merkle.op13_merkle(spark, saved(docs(spark, rows), tmp_path))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(rows)


@pytest.mark.parametrize("fanout", [3, 5])
def test_other_fanouts_give_proofs_that_verify(spark, fanout):
    rows = [(i, "=a" if i % 3 else f"=g{i % 5}", hashlib.sha256(str(i).encode()).digest()) for i in range(40)]
    found = merkle.prove(spark.createDataFrame(rows, "id long, grp string, node binary"), fanout=fanout)
    got = {r.id: r for r in found.withColumn("folded", merkle.folded(F.col("node"), F.col("proof"))).collect()}
    by = defaultdict(list)
    for i, g, node in rows:
        by[g].append((i, node.hex()))
    trees = {g: plain_tree([x for _, x in sorted(v)], fanout) for g, v in by.items()}
    root, _ = plain_tree([trees[g][0] for g in sorted(trees)], fanout)
    assert len(got) == 40 and all(r.root.hex() == root and r.folded.hex() == root and r.subroot.hex() == trees[r.grp][0] for r in got.values())
    for g, v in by.items():
        for (i, _), path in zip(sorted(v), trees[g][1]):
            assert [(p.before.hex(), p.after.hex()) for p in got[i].proof[: len(path)]] == path
    with pytest.raises(ValueError):
        merkle.prove(spark.createDataFrame(rows, "id long, grp string, node binary"), fanout=1)


def test_numbering_without_broadcast(spark):
    rows = spark.createDataFrame([(i % 50, "=a" if i % 4 else "=b") for i in range(200)], "id long, grp string")
    got = merkle.numbered(rows, ["id"], broadcast_ranges=0)[0].collect()
    for g in ("=a", "=b"):
        own = sorted((r.idx, r.id, r.n) for r in got if r.grp == g)
        assert [x for x, *_ in own] == list(range(own[0][2])) and [i for _, i, _ in own] == sorted(i for _, i, _ in own)


# Shards

DIMS = ["by_lang", "by_source", "by_length", "by_id"]


def plain_shards(rows, dims, shards):
    """rows: dictionaries with id, size, h, r and the dimensions. Each node's rows are sorted and cut where the left side is nearest to its share."""
    extent = lambda part, d: max(x[d] for x in part) - min(x[d] for x in part)
    whole = {d: max(1, extent(rows, d)) for d in dims} if rows else {}
    out = {}

    def split(part, first, k):
        if not part or k == 1:
            out.update({x["r"]: first for x in part})
            return
        dim = max(dims, key=lambda d: extent(part, d) / whole[d])
        part = sorted(part, key=lambda x: (x[dim], x["h"], x["r"]))
        goal, left = sum(x["size"] for x in part) * (k // 2) / k, [0]
        for x in part:
            left.append(left[-1] + x["size"])
        n = min(range(len(left)), key=lambda j: abs(left[j] - goal))
        split(part[:n], first, k // 2)
        split(part[n:], first + k // 2, k - k // 2)

    split(rows, 0, shards)
    return out


COPIES = [(7, "w " * 30, "en", "s", 9)] * 150
WHOLE, STEPS = (sharding.FINISH, sharding.BUCKETS), (3, 4000)


@pytest.mark.parametrize("rows,finish,buckets", [
    ([], *WHOLE), (sample(400), *WHOLE), (sample(200), *STEPS), (COPIES + sample(80), *STEPS), ([(1, "a", "en", "s", 1), (2, None, None, None, None)], *WHOLE),
    ([(i, "é" * (40_000 if i == 3 else 5), "en", "s", None) for i in range(60)], *WHOLE),
], ids=["empty", "several", "in_many_steps", "repeated", "fewer_than_shards", "long"])
def test_shards_are_those_of_a_plain_tree(spark, rows, finish, buckets):
    weights = sharding.weighed(docs(spark, rows))
    got = sharding.kd_shards(weights, DIMS, shards=12, finish=finish, buckets=buckets).collect()
    sizes = sorted(16 + len((r[1] or "").encode()) for r in rows)
    assert sorted(r.size for r in got) == sizes
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(0 <= r.shard < 12 for r in got)
    if len({r[:2] for r in rows}) < len(rows):  # the order of rows that are alike isn't known here
        return
    key = [F.col(c) for c in ("id", "size", "crc")]
    known = [r.asDict() | {"r": k} for k, r in enumerate(weights.withColumn("h", sharding.hashed(*key)).collect())]
    want = plain_shards(known, DIMS, 12)
    assert {r.id: r.shard for r in got} == {x["id"]: want[x["r"]] for x in known}


@pytest.mark.parametrize("finish,buckets", [(sharding.FINISH, sharding.BUCKETS), (0, 20_000)], ids=["as_it_is", "to_the_last_row"])
def test_sizes_are_nearly_equal_with_hot_sources_and_copies(spark, finish, buckets):
    rows = [(i if i % 3 else 5, "abc " * (20 if i % 3 == 0 else i % 40), "en" if i % 2 else "de", "hot" if i % 3 == 0 else f"s{i % 9}", i % 40) for i in range(3000)]
    got = sharding.kd_shards(sharding.weighed(docs(spark, rows)), DIMS, shards=10, finish=finish, buckets=buckets).groupBy("shard").agg(F.sum("size").alias("b"), F.max("size").alias("m")).collect()
    mean, most = sum(r.b for r in got) / 10, max(r.m for r in got)
    assert len(got) == 10 and all(abs(r.b - mean) <= 4 * most for r in got)


def test_target_bytes_and_query(spark, tmp_path):
    rows = sample(300)
    folder = saved(docs(spark, rows), tmp_path)
    found = sharding.kd_shards(sharding.weighed(docs(spark, rows)), DIMS, target_bytes=1000).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    total = sum(16 + len((r[1] or "").encode()) for r in rows)
    assert len(found) == -(-total // 1000) and max(r.b for r in found) < 1600
    got = sharding.op12_kd_sharding(spark, folder).collect()
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert len(got) == 300 and all(r.law == "bytes" and r.grown_shard is None and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in got)
    for bad in ({}, {"shards": 0}, {"target_bytes": 0}, {"shards": 2, "target_bytes": 5}):
        with pytest.raises(ValueError):
            sharding.kd_shards(sharding.weighed(docs(spark, rows)), DIMS, **bad)


# Divergence


def plain_terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if ord(c) >= 128 or "a" <= c <= "z" else " " for c in lower).split(" ")


def plain_divergence(rows, least=3, top=200):
    rows = [(r[2] or "", r[3] or "", [t for t in plain_terms(r[1]) if t]) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        in_docs = Counter(t for l, _, ts in rows if l == lang for t in set(ts))
        kept = sorted(t for t, n in in_docs.items() if n >= least)
        counts = {s: Counter() for l, s, _ in rows if l == lang}
        for l, s, ts in rows:
            if l == lang:
                counts[s].update(t for t in ts if in_docs[t] >= least)
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept)) for t in kept} for s, c in [*counts.items(), (None, sum(counts.values(), Counter()))]}
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("rows", [
    [], sample(150), [(1, None, None, None, None)], [(i, "rare" + "x" * i, "en", f"s{i}", 1) for i in range(3)],
    [(1, "Same same words", "en", "a", 1)] * 4 + [(2, "words", "en", "b", 1), (3, "123 !", "en", "c", 0)], [(i, "zz yy " * 20_000 if i else "a b c", "en", f"s{i % 2}", 1) for i in range(4)],
], ids=["empty", "several", "null", "none_kept", "repeated", "long"])
def test_divergence(spark, rows):
    got = divergence.divergences(docs(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows)


def test_divergence_with_small_bounds_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    rows = [(i, " ".join(f"w{chr(97 + (i * k) % 26)}{chr(97 + k % 26)}" for k in range(40)), "en", f"s{i % 5}", 1) for i in range(60)]
    got = divergence.divergences(docs(spark, rows), top=7, held=5, parts=3)
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows, top=7)
