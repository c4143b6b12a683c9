"""The whole pipeline against plain Python: each stage by brute force on what the stage before it kept."""

import hashlib
import random

import pytest
from test_dedup_and_scan import brute_contamination
from test_near_copies import brute, edited, shingles
from test_records_and_models import brute_lines

from geoloom.llm import bpe

MARKS = ["pfrunk", "zwoxel", "quixbad"]
QUESTIONS = {7: " ".join(f"question{chr(97 + i)}" for i in range(20)), 8: " ".join(f"answer{chr(97 + i)}" for i in range(9)), 9: None}


def wrapped(words, rng, width=None):
    """The words in lines of that many, or of ten to thirty; copies of another width do not share their lines."""
    lines, k = [], 0
    while k < len(words):
        n = width or rng.randint(10, 30)
        lines.append(" ".join(words[k : k + n]))
        k += n
    return "\n".join(lines)


def planted(rng):
    """doc_id, text, whether it is toxic; a third is, some are copies, share lines or hold questions."""
    syllables = ["ba", "ko", "ri", "tu", "ne", "sol", "mar", "vi", "den", "ga"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(2, 4)))
    own = {i: [word() for _ in range(rng.randint(120, 220))] for i in range(150)}
    texts = {i: wrapped(w, rng) for i, w in own.items()}
    toxic = {i for i in texts if i % 3 == 0}
    for i in toxic:
        words = texts[i].split(" ")
        for _ in range(3):
            words[rng.randrange(len(words))] = rng.choice(MARKS)
        texts[i] = " ".join(words)
    for k in range(30):
        # Copies with another layout and one edit at most, of six documents; of the toxic one each is toxic.
        base = [1, 2, 3, 4, 5, 7][k % 6]
        texts[200 + k] = wrapped(edited(rng, texts[base].split(), rng.randint(0, 1)).split(), rng, 31 + k)
    texts |= {240: texts[10], 241: texts[10], 242: f"{texts[10]}\nand something of its own in the last of all its lines here"}
    line = "the visitor {} from {} has seen the old gate of the town on the last day of the fair"
    for k in range(20):
        texts[250 + k] = f"{wrapped([word() for _ in range(90)], rng)}\n{line.format(k, word())}"
    texts[280] = line.format(99, "afar")
    for k, (item, share) in enumerate([(7, 60), (7, 3000), (8, 60), (8, 3000), (7, 0)]):
        texts[290 + k] = " ".join([*(word() for _ in range(share)), QUESTIONS[item].upper(), word()])
    texts[296] = " ".join([*(word() for _ in range(80)), *QUESTIONS[7].split()[:12]])
    texts |= {300: None, 301: "", 302: " \n\t", 303: "one word", 304: "Grüße <|endoftext|> 🙂 naïve"}
    return texts


def kept_lines(texts):
    cut = brute_lines({i: t for i, t in texts.items()})
    cut = {i: None if texts[i] is None else t for i, t in cut.items()}
    return {i: t for i, t in cut.items() if t == texts[i] or t.strip()}


def kept_firsts(texts):
    ids = sorted(texts)
    sets = [shingles(texts[i]) for i in ids]
    # Groups hold by pairs well above the limit, which wide fingerprints find.
    groups = brute(sets, 0.8)
    assert groups == brute(sets, 0.87) and sum(k != first for k, first in groups.items()) > 15
    return {ids[k]: texts[ids[k]] for k, first in groups.items() if k == first}


def kept_unseen(texts):
    def fouled(text):
        n, hit, _ = brute_contamination(text, QUESTIONS.items())
        return hit > 0 and 20 * hit >= n

    return {i: t for i, t in texts.items() if not fouled(t)}


@pytest.mark.parametrize("seed", [5])
def test_every_row_of_the_pipeline(spark, tmp_path, seed):
    import corpus_pipeline
    from tokenizers import Tokenizer

    texts = planted(random.Random(seed))
    bad = {i for i, t in texts.items() if any(m in (t or "") for m in MARKS)}
    rows = [(i, t, ["en", None, "de"][i % 3], f"s{i % 4}", None if t is None else len(t), "own") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in bad)) for i in texts if i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([*QUESTIONS.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    steps = [{i: t for i, t in texts.items() if i not in bad}]
    for stage in (kept_lines, kept_firsts, kept_unseen):
        steps.append(stage(steps[-1]))
    # Each stage has something to decide.
    assert len(texts) - len(steps[0]) > 40 and steps[1] != {i: steps[0][i] for i in steps[1]} and all(len(a) > len(b) for a, b in zip(steps, steps[1:]))
    assert {240, 241, 280, 290, 292, 294}.isdisjoint(steps[-1]) and {10, 242, 291, 296, 303, 304} <= steps[-1].keys()

    library = Tokenizer.from_file(bpe.default_path())
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t in steps[-1].items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (["en", None, "de"][i % 3], f"s{i % 4}", len(ids), ids, digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    found = got.collect()
    assert len(found) == len(want) and {r.doc_id: tuple(r)[1:] for r in found} == want
