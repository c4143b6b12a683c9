"""Exact dedup, SimHash, contamination and BPE against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from geoloom.llm import bpe, contamination, exact_dedup, simhash
from geoloom.llm.components import components

DOCS = "doc_id long, text string, lang string, n string"
SPACE = re.compile("[\x20\x09-\x0d]+")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts)], DOCS)


# --- exact dedup


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i))
    keep = {n: (min(g)[1], len(g)) for n, g in groups.items()}
    return sorted((i, *keep[n], i == keep[n][0], hashlib.sha256(n.encode()).hexdigest()) for i, t in rows for n in [SPACE.sub("", t or "")])


@pytest.mark.parametrize("key", [exact_dedup.md5_key, lambda t: F.substring(F.md5(t.cast("binary")), 1, 1), lambda t: F.lit("same")])
def test_exact_groups(spark, key):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "a b", "ab", "a  b", "A b", " ab", "ab" * 40000, "é" * 5, *("".join(rng.choices("ab ", k=3)) for _ in range(150))]
    frame = docs(spark, texts).withColumn("h", F.lit(1)).withColumn("id", F.lit(2)).withColumn("norm", F.lit(""))
    got = exact_dedup.exact_groups(frame, key=key)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == brute_exact(list(enumerate(texts)))


def test_exact_empty_repeated_null(spark):
    assert exact_dedup.exact_groups(docs(spark, []).select("doc_id", "text")).count() == 0
    got = exact_dedup.exact_groups(spark.createDataFrame([(None, "a"), (3, "a"), (3, "a")], "doc_id long, text string"))
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in got.collect()) == [(-1, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True)]


def test_exact_main_path_is_native(spark):
    plan = exact_dedup.exact_groups(docs(spark, ["a"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- SimHash


def brute_print(text):
    words = [w for w in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids, root = list(prints), {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint():
    rng = random.Random(2)
    for text in [None, "", "\n", "A", "a b", "É A b c", "x" * 9, *(" ".join(rng.choices("abcdé", k=rng.randint(1, 40))) for _ in range(60)), "w é " * 70000]:
        assert simhash.fingerprint(text) == brute_print(text)


@pytest.mark.parametrize("dense", [0, 2, 1000])
def test_links_find_every_component(spark, dense):
    rng = random.Random(dense)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    prints = list(base)
    for b in base:
        for _ in range(12):
            for k in rng.sample(range(64), rng.randint(0, 4)):
                b ^= 1 << k
            prints.append(b)
    prints = dict(enumerate(dict.fromkeys(prints)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in prints.values()], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(frame, dense)).collect()}
    wanted = brute_components(prints)
    for i in prints:
        for j in prints:
            a, b = signed(prints[i]), signed(prints[j])
            assert (roots.get(a, a) == roots.get(b, b)) == (wanted[i] == wanted[j])


def test_near_components(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    long = [rng.choice(words) for _ in range(400)]
    texts = [None, "", "a", "A", "b c"]
    for _ in range(30):
        copy = list(long)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(400)] = "zz"
        texts.append(" ".join(copy))
    got = simhash.near_components(docs(spark, texts).withColumn("fp", F.lit(1)))
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_components(prints)
    assert simhash.near_components(docs(spark, [])).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# --- contamination


def brute_contamination(text, items):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, who = find(text), set(), set()
    for item, said in items:
        w = find(said)
        for k in range(max(1, len(w) - 12)) if w else []:
            part = w[k : k + 13]
            for i in range(len(words) - len(part) + 1):
                if words[i : i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    who.add(str(item))
    return len(words), len(hit), sorted(who)


@pytest.mark.parametrize("shard, piece", [(contamination.SHARD_CHARS, contamination.PIECE), (6000, 20)])
def test_contamination(spark, monkeypatch, shard, piece):
    monkeypatch.setattr(contamination, "PIECE", piece)
    rng = random.Random(4)
    word = lambda: rng.choice(["ab", "b", "Ab", "é", "x1", "ñu", "cd", "ef"])
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(12)] + [(50, ""), (51, None), (52, "b"), (3, "again the same")]
    texts = [None, "", "...", "B", "bb", "Ab"]
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 20)))]
        for _ in range(rng.randint(0, 2)):
            said = rng.choice(items)[1] or ""
            parts += [said.upper().replace("É", "é").replace("Ñ", "ñ").replace(" ", ", "), "zz"]
        texts.append("; ".join(parts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in contamination.find_contamination(docs(spark, texts).withColumn("items", F.lit(1)), bench, shard_chars=shard).collect()}
    for i, text in enumerate(texts):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == brute_contamination(text, items)
        n = sum(len(contamination.WORDS.findall(contamination.lowered(text[s.start : s.end]))) for s in got[i].spans)
        assert n == got[i].n_hit
    assert contamination.find_contamination(docs(spark, texts), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert contamination.find_contamination(docs(spark, []), bench).count() == 0


# --- BPE


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    own, library = bpe.Codec(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    letters = list("abcdefghijklmnopqrstuvwxyzABC  \n\t'0123-=._/\\éñß漢字🙂\u0085​\x1c\x00")
    texts = [None, "", "a<|endoftext|>b <|endoftext|>", "<|endoftext", " " * 300 + "a", "=" * 100, "a" * 60000, "-" * 129, "ab " * 400000]
    texts += ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += [b"".join(own.token_bytes[i] for i in rng.choices(range(50256), k=rng.randint(1, 6))).decode("utf-8", "ignore") for _ in range(3000)]
    rows = bpe.encode_decode(docs(spark, texts).withColumn("ids", F.lit(1)), path, keep=["doc_id"]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False) == (texts[r.doc_id] or "")
    assert bpe.encode_decode(docs(spark, []), path).count() == 0


def test_bpe_verification_decides(spark):
    """Words whose greedy proposal fails are found by the pair checks alone."""
    own = bpe.Codec(bpe.default_path())
    rng = random.Random(8)
    words = list({"".join(rng.choices("abcdefghilmnorstu", k=rng.randint(1, 14))).encode() for _ in range(4000)})
    words += [b"ab" * 300, b"a"]
    flat, sizes = own.proposals(words)
    tries = np.split(flat, np.cumsum(sizes)[:-1])
    differ = 0
    for w, ids, tried, exact in zip(words, own.encode_words(words), tries, own.exact(words)):
        assert ids == exact and np.frombuffer(exact, "<i4").tolist() == own._exact_long(w)
        assert b"".join(own.token_bytes[i] for i in tried) == w
        differ += tried.tolist() != own._exact_long(w)
    assert differ > 100


def test_words_begin_where_the_pattern_says(monkeypatch):
    own, rng = bpe.Codec(bpe.default_path()), random.Random(18)
    letters = list("strevlmda'' \t\n\x1c\x85\u00a0\u3000x1²½Ⅷ.!_é漢🙂")
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 20)
    for _ in range(3000):
        texts = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(rng.randint(1, 4))]
        wanted, at = [], 0
        for t in texts:
            wanted += [at + m.start() for m in regex.finditer(bpe.PATTERN, t)]
            at += len(t)
        pieces = np.cumsum([0, *map(len, texts[:-1])])
        assert own.starts(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), pieces).tolist() == wanted
        long = "".join(texts) * 9
        assert "".join(bpe.blocks(long)) == long
        assert [w for part in bpe.blocks(long) for w in regex.findall(bpe.PATTERN, part)] == regex.findall(bpe.PATTERN, long)


def test_a_full_memo_changes_nothing(monkeypatch):
    own, rng = bpe.Codec(bpe.default_path()), random.Random(19)
    texts = [" ".join("".join(rng.choices("abcde", k=rng.randint(1, 5))) for _ in range(300)) for _ in range(8)]
    whole = own.encode(texts)
    monkeypatch.setattr(bpe, "MEMO_BYTES", 3000)
    small = bpe.Codec(bpe.default_path())
    for _ in range(2):
        again = small.encode(texts)
        assert (again[0] == whole[0]).all() and (again[1] == whole[1]).all()
    assert max(len(small.young), len(small.old)) < 40 < len(own.young)
