"""WARC, chat, URL rules, toxicity, line dedup, language model and the pipeline on small tables."""

import base64
import gzip
import hashlib
import math
import random
import zlib
import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import chat, line_dedup, toxicity, url_filter, warc
from geoloom.llm.common import new_path

# --- WARC


def archive(spark, rows, min_bytes=0, per_file=1000):
    frame = spark.createDataFrame([(i, u, None if p is None else p.encode(), "x") for i, u, p in rows], "id long, url string, payload binary, digest string")
    path = new_path(spark, "warc-test")
    frame = frame.withColumn("payload", F.coalesce("payload", F.lit("").cast("binary")))
    warc.write_warc(warc.mark_revisits(frame, min_bytes), path, records_per_file=per_file)
    return path


@pytest.mark.parametrize("min_bytes", [0, 3])
def test_warc_round_trip(spark, min_bytes):
    big = "ü<html>\r\n\r\nWARC/1.1\r\n\r\n" * 30000
    payloads = [None, "", "a", "a", "abc", "abc", big, "abc", big, "\r\n\r\n", "a"]
    rows = [(100 - i, f"http://x/{i}\r\nEvil: 1" if i % 3 else None, p) for i, p in enumerate(payloads)]
    path = archive(spark, rows, min_bytes, 2)
    got = {int(r.id): r for r in warc.resolve_revisits(warc.read_warc(spark, path)).collect()}
    for i, _, p in rows:
        data = (p or "").encode()
        first = min(j for j, _, q in rows if (q or "") == (p or ""))
        revisit = len(data) >= min_bytes and first != i
        assert got[i].digest == base64.b32encode(hashlib.sha1(data).digest()).decode() and got[i].intact
        assert (got[i].record_type, got[i].bytes, got[i].refers_to) == ("revisit" if revisit else "response", len(data), str(first) if revisit else None)


@pytest.mark.parametrize("per_file", [1, 1000])
def test_payloads_that_end_in_line_breaks(spark, per_file):
    ends = ["", "\r\n", "\r", "\n", "\r\n\r\n", "\r\n\r\n\r\n", "\n\r", "\r\r\n"]
    payloads = [body + end for end in ends for body in ("<html>a</html>", "", "\r\nb")]
    rows = [*enumerate(payloads), *((100 + i, p) for i, p in enumerate(payloads))]
    got = {int(r.id): r for r in warc.resolve_revisits(warc.read_warc(spark, archive(spark, [(i, "u", p) for i, p in rows], per_file=per_file))).collect()}
    assert len(got) == len(rows) and all(r.intact for r in got.values())
    for i, p in rows:
        first = payloads.index(p)
        assert (got[i].bytes, got[i].refers_to) == (len(p), None if i == first else str(first))
    for p in ("x\r\n", "\r", "\r\n\r\n\r\n"):
        (one,) = warc.read_warc(spark, archive(spark, [(1, "u", p)])).collect()
        assert one.intact and one.bytes == len(p)


def test_warc_files_are_plain_warc(spark, tmp_path):
    path = archive(spark, [(1, "http://x/", "one"), (2, "http://y/", "one")])
    data = b"".join(gzip.decompress(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect())
    assert data.count(b"WARC/1.1\r\n") == 2 and data.endswith(b"\r\n\r\n")
    kinds = sorted(h["warc-type"] for h, _ in warc.parse_warc([data]))
    assert kinds == ["response", "revisit"]
    assert [*warc.parse_warc(data[i : i + 1] for i in range(len(data)))] == [*warc.parse_warc([data])]
    with pytest.raises(ValueError):
        list(warc.parse_warc([data[:-6]]))


@pytest.mark.parametrize("bound", [0, 10**6])
def test_revisits_with_clashing_columns(spark, bound):
    rows = [(1, "u", b"a", "x", 5), (2, "u", b"a", "y", 6), (3, "u", b"b", "z", 7), (None, "u", b"a", None, None)]
    frame = spark.createDataFrame(rows, "id long, url string, payload binary, original string, n int").withColumn("first", F.lit(1)).withColumn("digest", F.lit("q"))
    got = sorted((r.id or 0, r.original, r.revisit) for r in warc.mark_revisits(frame, broadcast_groups=bound).collect())
    assert got == [(0, 1, True), (1, 1, False), (2, 1, True), (3, 3, False)]


def test_warc_empty_repeated_and_null_id(spark):
    assert warc.read_warc(spark, archive(spark, [])).count() == 0
    got = warc.resolve_revisits(warc.read_warc(spark, archive(spark, [(None, None, "p"), (4, None, "p"), (4, None, "p")]))).collect()
    assert sorted((r.id or "", r.record_type, r.refers_to) for r in got) == [("", "revisit", "4"), ("4", "response", None), ("4", "response", None)]


# --- chat


def test_turns_survive():
    rng = random.Random(1)
    parts = ["###", "#", "\\", "</turn>", "<", "/turn>", ": ", "user", "\n", "é", " ", "### x: "]
    for _ in range(3000):
        role, text = ("".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(2))
        piece = chat.render_turn(role, text)
        assert [x[:2] for x in chat.parse_turns(piece + piece)] == [(role, text)] * 2
    assert chat.render_turn("user", "plain") == "### user: plain</turn>\n"


def test_conversations(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 2, "assistant", "b" * 300000), (1, 1, "user", said), (1, None, None, None), (2, 1, "assistant", said), (2, 1, "assistant", said), (None, 0, "user", "x"), *((1, 3, r, t) for r, t in (("a 1", "x!"), ("a", "x"), ("a", "x!"), ("a", "### x"), ("a", "A"), ("a", "A\\")))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1)).withColumn("piece", F.lit("p"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(frame)).collect()}
    for conv in (1, 2, None):
        turns = sorted((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv].formatted_chars == sum(len(chat.render_turn(r, x)) for _, r, x in turns)
    assert chat.read_back(chat.format_turns(frame.limit(0))).count() == 0


# --- URLs


def brute_url(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


@pytest.mark.parametrize("bound", [10**6, 0])
def test_urls(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", bound)
    rules = [*url_filter.RULES, ("allow", "a.b", ""), ("block", "a.b", ""), ("block", "é.x", "/ü")]
    hosts, paths = ["com", "x.com", "example.com", "NET", "q.example.net", "a.b", "z.a.b", "É.x", "é.x", "", "com.", ".com", "ecom"], ["/en/", "/en/7", "/en", "/de/8x", "/es/", "", "/ü?x", "?/en/", "#/en/", "/en/#/"]
    urls = [None, "", "com/en/", "://", "http://" + "s." * 300 + "com/en/" + "x" * 5000, *(f"{s}://{h}{p}" for h in hosts for p in paths for s in ("http", "a://b"))]
    frame = spark.createDataFrame([(i, u, "q", "z") for i, u in enumerate(urls)], "page_id long, url string, verdict string, suffix string")
    got = {r.page_id: r for r in url_filter.filter_urls(frame, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == brute_url(u, rules), u
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r.verdict for r in url_filter.filter_urls(frame, none, default="block").collect()} == {"block"}
    assert url_filter.filter_urls(frame.limit(0), none).count() == 0


# --- toxicity


def insults(rng, n, share):
    syllables = ["ba", "ko", "ri", "tu", "ne", "sol", "mar", "vi", "den", "ga"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows = []
    for i in range(n):
        toxic, words = rng.random() < share, [word() for _ in range(rng.randint(20, 80))]
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["Zwoxel", "pfrunk", "quixbad"]) + rng.choice(["", ".", "ba", "ko"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_held_out_accuracy(spark):
    rows = insults(random.Random(3), 800, 0.2)
    more = [(10_000, None), (10_001, ""), (10_002, "w" * 300_000), (None, "pfrunk you"), (10_003, "pfrunk " * 100_000)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(i, t, "s") for i, t in more], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, rows[5][2]), (None, 1), (7777, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels, keep=["doc_id"]).collect()}
    held = [(y, got[i].predicted) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and sum(y == p for y, p in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[10_000].predicted == got[10_001].predicted == got[10_002].predicted == 0 and got[None].predicted == got[10_003].predicted == 1
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, flipped, keep=["doc_id"]).collect()}
    assert again == {i: r.score for i, r in got.items()}
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_by_brute_force(spark):
    """Scores of whole texts, window by window without a memo, and the calibration by rows left out."""
    rows = insults(random.Random(8), 300, 0.25)
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    ordinary, toxic, shares = toxicity.fit(frame, labels)
    own = toxicity.Distance(ordinary, toxic)
    assert shares == sorted(shares) and 0 <= shares[0] and shares[-1] <= 1

    def distance(text):
        best = 0
        for w in text.encode().lower().split():
            shown = toxicity.BEFORE + b" " + w.strip(toxicity.MARKS) + b" " + toxicity.AFTER
            best = max(best, len(own.pair[0].compress(shown)) - len(own.pair[1].compress(shown)))
        return min(best, toxicity.TOP)

    got = {r.doc_id: r.score for r in toxicity.score_toxicity(frame, labels, keep=["doc_id"]).collect()}
    assert got == {i: shares[distance(t)] for i, t, _ in rows}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    wrong = [i for i, t, y in rows if held(i) and (got[i] >= toxicity.THRESHOLD) != bool(y)]
    assert len(wrong) <= 0.05 * sum(held(i) for i, _, _ in rows)


def test_long_labelled_rows_take_part(spark):
    """With their whole texts, wherever the pattern stands."""
    filler = " ".join("".join(random.Random(k).choices("abcdefgh", k=6)) for k in range(40_000))
    long = [f"{filler} {' '.join(f'pfrunk x{k}y' for k in range(400))}" for _ in range(8)]
    rows = [(i, t, 1) for i, t in enumerate(long)] + [(100 + i, " ".join(random.Random(i).choices(filler.split()[:3000], k=60)), 0) for i in range(60)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    _, toxic, _ = toxicity.fit(frame, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert len(long[0]) > 160_000 and b"pfru" in toxic
    late = [(i, f"{filler} {filler} " + " ".join(f"zwox x{k}y" for k in range(100)), 1) for i in range(8)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in late + rows[8:]], "doc_id long, text string")
    _, toxic, _ = toxicity.fit(frame, spark.createDataFrame([(i, y) for i, _, y in late + rows[8:]], "doc_id long, toxic int"))
    assert b"zwox" in toxic


# --- lines

PASSAGE = " ".join(f"shared{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(60))


@pytest.mark.parametrize("bound", [10**6, 0])
def test_lines(spark, bound):
    rng = random.Random(6)
    own = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.randint(10, 30)))
    texts = [f"{own()}\n{PASSAGE}\n\n{own()}" for _ in range(6)] + [own() for _ in range(20)]
    texts += [f"{own()}\nOn day {i} at {i * 7} the visitor number {i} has seen the large old gate" for i in range(5)]
    texts += [PASSAGE.replace("sharedk", "changed") + "\n" + own(), None, "", "\n\n", own() + "\n" + "x " * 50_000, "same line of more than ten words that stands in one document twice\n" * 2]
    frame = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, PASSAGE, 3)], "doc_id long, text string, n_lines int")
    got = {r.doc_id: r for r in line_dedup.drop_lines(frame, broadcast_lines=bound).collect()}
    kept = [i for i in range(len(texts)) if PASSAGE in (got[i].text or "")]
    assert kept == [0] and "changed" not in got[31].text
    assert got[26].n_dropped == 0 and all(got[i].n_dropped == 1 and "visitor" not in got[i].text for i in range(27, 31))
    assert got[None].text == PASSAGE and got[32].text is None and got[33].text == ""
    for i in [*range(6, 26), 34, 35, 36]:
        assert got[i].text == texts[i]
    assert line_dedup.drop_lines(frame.limit(0)).count() == 0


def test_many_variants_of_one_template_are_dropped(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    own = [f"the visitor from {word()} {' '.join(word() for _ in range(12))}" for _ in range(400)]
    texts = [f"{own[i]}\nthe visitor from {word()} has seen the old gate of the town and went home" for i in range(400)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    # The name is the fourth token, where a split by more leading tokens takes every variant apart.
    frame = frame.unionByName(spark.createDataFrame([(1000, texts[7].split("\n")[1])], "doc_id long, text string"))
    got = {r.doc_id: r for r in line_dedup.drop_lines(frame).collect()}
    assert got[0].text == texts[0] and all(got[i].text == own[i] for i in range(1, 400)) and got[1000].text == ""


def test_short_lines_take_part(spark):
    names = ["anna", "bert", "cleo", "dora"]
    texts = [f"own{chr(97 + i)} words\nThe end.\nBye\nsession was closed by {n}\n{10 + i}\nat {i} o'clock" for i, n in enumerate(names)]
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(frame).collect()}
    # A bare number is no template; it goes only where the same one recurs.
    assert got == {0: texts[0]} | {i: f"own{chr(97 + i)} words\n{10 + i}" for i in range(1, 4)}
    copies = spark.createDataFrame([(1, "7\n12 13"), (2, "7\n12 14")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.drop_lines(copies).collect()} == {1: "7\n12 13", 2: "12 14"}


def cut_line(line):
    """Tokens as the template tree sees them."""
    words = line.split()
    tokens = tuple("<*>" if any(c in "0123456789" for c in w) else w for w in words)
    return tuple(words) if all(t == "<*>" for t in tokens) else tokens


def brute_lines(texts):
    """The template tree in plain Python, with real tokens instead of their prints and every template compared."""
    docs, groups, home = {}, {}, {}
    for i, text in texts.items():
        for tokens in dict.fromkeys(map(cut_line, (text or "").split("\n"))):
            if tokens:
                docs.setdefault(tokens, []).append(i)
    for tokens, ids in docs.items():
        key = (len(tokens), tokens[:3]) if len(tokens) >= line_dedup.LONG else tokens
        groups.setdefault(key, []).append((min(ids), line_dedup.line_keys([" ".join(tokens).encode()])[0], tokens, max(ids)))
    for rows in groups.values():
        templates = []
        for first, _, tokens, last in sorted(rows):
            scores = [sum(f and a == b for a, b, f in zip(tokens, t[0], t[1])) / len(tokens) for t in templates]
            if scores and max(scores) >= line_dedup.SIMILAR:
                best = templates[scores.index(max(scores))]
                best[1] = [f and a == b for a, b, f in zip(tokens, best[0], best[1])]
            else:
                best = [tokens, [True] * len(tokens), []]
                templates.append(best)
            best[2].append((first, last, tokens))
        for _, _, lines in templates:
            low, high = min(x[0] for x in lines), max(x[1] for x in lines)
            home |= {tokens: low for _, _, tokens in lines if low < high}
    return {i: "\n".join(x for x in (text or "").split("\n") if not cut_line(x) or home.get(cut_line(x), i) == i) for i, text in texts.items()}


@pytest.mark.parametrize("n", [60, 600])
def test_lines_by_brute_force(spark, n):
    """At two sizes, with one template that a third of all documents vary."""
    rng = random.Random(n)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "x1", "77", "omega"])
    base = [[f"{chr(97 + i)}{chr(97 + k)}q" for k in range(rng.randint(1, 24))] for i in range(8)]

    def line():
        words = list(rng.choice(base)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(1, 8))]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = word()
        return " ".join(words)

    hot = "the gate of the town was seen by all the visitors from {} who came on the day of the {} fair"
    texts = {i: "\n".join([line() for _ in range(rng.randint(0, 6))] + ([hot.format(f"place{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}", word())] if i % 3 == 0 else [])) for i in range(n)}
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_lines(texts)


def test_lines_without_a_common_token_stay(spark):
    texts = {1: "agw acd awx aaj ave alw", 2: "ald amn azc bab bmc bnc", 3: "agw acd awx bab bmc bnc"}
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == texts


def test_many_distinct_tokens(spark):
    """10^5 distinct tokens: more than 16 bits could tell apart; some leaves have many lines."""
    rng, digits = random.Random(5), "abcdefghijklmnopqrstuvwxyz"
    token = lambda k: "".join(digits[k // 26**p % 26] for p in range(4))
    order = rng.sample(range(26**4), 100_000)
    lines = [" ".join(token(k) for k in order[j : j + 20]) for j in range(0, 100_000, 20)]
    lines += [" ".join(["one", "two", "three", *x.split()[: 3 + j % 5]]) for j, x in enumerate(lines)]
    lines += [" ".join([*x.split()[:19], "other"]) for x in lines[:500]]
    texts = {i: "\n".join(lines[i::300]) for i in range(300)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_lines(texts)
    for bound in (10**6, 0):
        assert {r.doc_id: r.text for r in line_dedup.drop_lines(frame, broadcast_lines=bound, broadcast_leaves=bound).collect()} == want
    assert sum(len(x) for x in want.values()) < sum(len(x) for x in texts.values())


def test_lines_whose_leaf_keys_are_equal(spark, monkeypatch):
    known = line_dedup._templates
    rows = [(1, b"a b c d e f"), (2, b"x y z d e f"), (3, b"a b c d e g")]
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([0] * 3), pa.array([6] * 3, pa.int32()), pa.array([7] * 3), pa.array([x for _, x in rows]), pa.array([1, 2, 3]), pa.array([1, 2, 3])],
                                       ["high", "low", "n", "leaf", "line", "first", "last"])
    (out,) = known([batch])
    assert out.column("template_high").to_pylist() == [1, 2, 1]


def test_bands_lose_no_template():
    rng = random.Random(13)
    for n in (10, 11, 14, 15, 19, 20, 33):
        wrong = n - math.ceil(line_dedup.SIMILAR * n - 1e-9)
        line = np.arange(n, dtype=np.uint16)
        for _ in range(200):
            leaf, near = line_dedup.Leaf(), line.copy()
            near[rng.sample(range(line_dedup.LEAD, n), wrong)] += 500
            assert [leaf.place(1, line), leaf.place(2, near)] == [1, 1]


def test_a_template_generalises():
    leaf = line_dedup.Leaf()
    line = np.arange(20, dtype=np.uint16)
    near, far = line.copy(), line.copy()
    near[:4] += 100
    far[:5] += 200
    assert [leaf.place(1, line), leaf.place(2, near), leaf.place(3, far)] == [1, 1, 3]


# --- pipeline


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline
    from geoloom.llm import bpe

    rng = random.Random(11)
    rows = insults(rng, 260, 0.2)
    question = " ".join(f"question{chr(97 + i)}" for i in range(20))
    clean = [i for i, _, y in rows if not y]
    texts = dict((i, t) for i, t, _ in rows)
    texts[1000], texts[1001] = texts[clean[0]], question
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 1000 not in got and 1001 not in got
    assert len(set(clean) - got.keys()) <= 0.02 * len(clean)
    assert len(got.keys() - set(clean)) <= 0.05 * (len(rows) - len(clean))
    own = bpe.Codec(bpe.default_path())
    assert all(own.decode(r.ids) == texts[i] for i, r in got.items())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe"]
