"""Byte-level BPE by speculation and verification.

Text is cut into words by the tokenizer's pattern. For each new word a greedy longest match
proposes tokens. A proposal equals the merge result exactly if every two neighbouring tokens are
compatible: no merge across their border comes before the merges inside the two. Numpy tests all
neighbouring pairs of a block of words at once; only words with a failing pair are merged exactly
(a heap over the pairs). The new words of a whole batch of rows are encoded at once; results of
short words are kept in a memo of each worker, bounded in bytes.

Cases: a null or empty text has no tokens and decodes to an empty text; strings of added tokens are
matched in the text, longest first, as the tokenizers library does by default; texts and words of
any length are whole (long texts go by parts cut at white space, long words are not kept in the memo);
repeated rows are encoded each; an empty table gives an empty result; columns named ids or decoded
are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.common import bounded, give_back, table

#: Bytes of one half of a worker's memo, what an entry takes besides its bytes, and the longest word kept there.
MEMO_BYTES, ENTRY_BYTES, MEMO_WORD_BYTES = 32 << 20, 180, 64
#: Characters of texts handled at once, of a part of a long text, and words encoded at once.
BATCH_CHARS, BLOCK_CHARS, BLOCK_WORDS = 1 << 20, 1 << 20, 50_000

#: Fixed value: the word pattern of the byte-level pre-tokenizer, which `Codec.starts` follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NEVER, NO_RANK = np.int64(1) << 40, np.int64(1) << 40
SPACE, LETTER, NUMBER, OTHER = range(4)
BLANK, APOSTROPHE = ord(" "), ord("'")
_begins_space = regex.compile(r"\S(?=\s)")
#: Words up to this many bytes are merged together by searching their pairs, longer ones by a heap.
SHORT_WORD = 32
#: Words merged exactly at once.
EXACT_WORDS = 8192
#: No byte, as a character.
MARK = chr(256)


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def kinds() -> np.ndarray:
    """Of every code point: white space, letter, number or other, as the word pattern sees them."""
    found = np.full(0x110000, OTHER, np.uint8)
    for begin, end in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(begin, end)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                found[begin + m.start() : begin + m.end()] = kind
    return found


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_alphabet()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        n = self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * n
        for word, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in word)
        for word, i in self.added.items():
            self.token_bytes[i] = word.encode()
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        left, right, rank = np.full(n, -1), np.full(n, -1), np.full(n, -1, np.int64)
        for r, (a, b) in enumerate(merges):
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.merge.setdefault(pair, (r, made))
            if rank[made] < 0:
                left[made], right[made], rank[made] = *pair, r
        keys = np.array([a * n + b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        # The tokens at a token's right (left) border over time, and when each is absorbed by the next.
        self.right_edge, self.right_until = self._edges(right, rank)
        self.left_edge, self.left_until = self._edges(left, rank)
        # Only tokens that merging their own bytes gives back can be proposed.
        made = np.flatnonzero(rank >= 0)
        whole = self.compatible(left[made], right[made], rank[made])
        ids = [*made[whole].tolist(), *self.byte_id]
        self.longest = ahocorasick.Automaton()
        for i in ids:
            self.longest.add_word(self.token_bytes[i].decode("latin-1"), i)
        self.longest.add_word(MARK, -1)
        self.longest.make_automaton()
        self.made_by = np.zeros(len(merges), np.int64)
        for r, made in self.merge.values():
            self.made_by[r] = made
        self.kinds = kinds()
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.token_array = pa.array(self.token_bytes, pa.binary())
        # Two halves: when the young one is full it becomes the old one, from which words in use come back.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.filled = 0

    def _edges(self, part, rank):
        edges, until = [np.arange(self.size)], [np.full(self.size, NEVER)]
        while (edges[-1] >= 0).any():
            up = edges[-1]
            has = up >= 0
            edges.append(np.where(has, part[up], -1))
            until.append(np.where(has, rank[up], -1))
        return edges[:-1], until[:-1]

    def compatible(self, a, b, limit=None):
        """Whether each pair of tokens a[i], b[i] stays apart when the bytes of both are merged (up to merge number limit[i])."""
        good = np.ones(len(a), bool)
        for u_edge, u_until in zip(self.right_edge, self.right_until):
            i = np.flatnonzero(good & (u_edge[a] >= 0))
            if not len(i):
                break
            for v_edge, v_until in zip(self.left_edge, self.left_until):
                i = i[v_edge[b[i]] >= 0]
                if not len(i):
                    break
                u, v = u_edge[a[i]], v_edge[b[i]]
                key = u * np.int64(self.size) + v
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found, when = self.keys[at] == key, self.ranks[at]
                tu, tv = u_until[a[i]], v_until[b[i]]
                if limit is not None:
                    tu, tv = np.minimum(tu, limit[i]), np.minimum(tv, limit[i] - 1)
                # Of equal pairs the leftmost merges first: across the border before the right token's own.
                good[i[found & (when < tu) & (when <= tv)]] = False
        return good

    def proposals(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches: token ids of all words, and how many each has."""
        # Bytes as characters; the mark behind each word is no byte, so that no match crosses it.
        found = self.longest.iter_long(MARK.join(x.decode("latin-1") for x in words) + MARK)
        flat = np.fromiter((t for _, t in found), np.int64)
        ends = np.flatnonzero(flat < 0)
        return flat[flat >= 0], np.diff(ends - np.arange(len(ends)), prepend=0)

    def _ranks(self, a, b) -> np.ndarray:
        """The merge number of each pair, NO_RANK where there is none; -1 is no token."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.ranks[at], NO_RANK)

    def exact(self, words: list[bytes]) -> list[bytes]:
        """Packed ids by merges in order of rank, leftmost first: of all short words at once, of long ones by a heap."""
        out = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order and len(words[order[-1]]) > SHORT_WORD:
            i = order.pop()
            out[i] = np.array(self._exact_long(words[i]), "<i4").tobytes()
        for begin in range(0, len(order), EXACT_WORDS):
            part = order[begin : begin + EXACT_WORDS]
            for i, x in zip(part, self._exact_short([words[i] for i in part])):
                out[i] = x
        return out

    def _exact_short(self, words: list[bytes]) -> list[bytes]:
        width = max(map(len, words))
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        inside = np.arange(width) < np.fromiter(map(len, words), np.int64, len(words))[:, None]
        # One more column than the longest word has, so that every last token has a neighbour.
        ids = np.full((len(words), width + 1), -1, np.int64)
        ids[:, :width][inside] = np.array(self.byte_id)[data[inside]]
        ranks, done = self._ranks(ids[:, :-1], ids[:, 1:]), ids.copy()
        rows, places = np.arange(len(words)), np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)
            own = np.arange(len(rows))
            best = ranks[own, at]
            over = best == NO_RANK
            if over.any():
                done[rows[over]] = ids[over]
                rows, ids, ranks, at, best = rows[~over], ids[~over], ranks[~over], at[~over], best[~over]
                own = np.arange(len(rows))
            if not len(rows):
                break
            behind = places > at[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            ids[own, at] = self.made_by[best]
            ranks[:, :-1] = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NO_RANK
            ranks[own, at] = self._ranks(ids[own, at], ids[own, at + 1])
            left = np.flatnonzero(at)
            ranks[left, at[left] - 1] = self._ranks(ids[left, at[left] - 1], ids[left, at[left]])
        kept = done >= 0
        flat, ends = done[kept].astype("<i4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [flat[i:j] for i, j in pairwise([0, *ends])]

    def _exact_long(self, word: bytes) -> list[int]:
        """The same by a heap over neighbouring pairs, for words whose pairs are too many to search again and again."""
        ids, n = [self.byte_id[b] for b in word], len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merge.get((made, ids[k])):
                    heapq.heappush(heap, (m[0], i, made, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := self.merge.get((ids[h], made))):
                heapq.heappush(heap, (m[0], h, ids[h], made, m[1]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word, as packed 32-bit numbers."""
        flat, sizes = self.proposals(words)
        word_of = np.repeat(np.arange(len(words)), sizes)
        inside = np.flatnonzero(word_of[1:] == word_of[:-1])
        pairs, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        packed, ends = flat.astype("<i4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        made = [packed[i:j] for i, j in pairwise([0, *ends])]
        failed = np.unique(word_of[inside[~good[back]]]).tolist()
        for i, x in zip(failed, self.exact([words[i] for i in failed])):
            made[i] = x
        return made

    def starts(self, points: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """Where the words begin in pieces of text, laid end to end as code points; `pieces` are the places where they begin."""
        kind, n = self.kinds[points], len(points)
        first = np.zeros(n + 1, bool)
        first[pieces] = first[n] = True
        new = first.copy()
        new[1:n] |= kind[1:] != kind[:-1]
        # A space goes with the run behind it; other white space there is a word of its own.
        after = np.flatnonzero(new[1:n] & ~first[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
        new[after - 1] = True
        new[after[points[after - 1] == BLANK]] = False
        # Endings behind an apostrophe that begins a word.
        at = np.flatnonzero((points[:-1] == APOSTROPHE) & new[: n - 1] & ~first[1:n])
        one, two = points[at + 1], points[np.minimum(at + 2, n - 1)]
        longer = ~first[at + 2] & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
        short = np.isin(one, [ord(x) for x in "stmd"])
        new[at[short | longer] + 1] = False
        new[at[short] + 2] = True
        new[at[longer] + 3] = True
        return np.flatnonzero(new[:n])

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Packed token ids of distinct words, from the memo or made at once."""
        young, old = self.young, self.old
        found = [*map(young.get, words)]
        for i, x in enumerate(found):
            if x is None and (y := old.get(words[i])) is not None:
                found[i] = young[words[i]] = y
                self.filled += len(words[i]) + len(y) + ENTRY_BYTES
        new = [i for i, x in enumerate(found) if x is None]
        for begin in range(0, len(new), BLOCK_WORDS):
            part = new[begin : begin + BLOCK_WORDS]
            for i, x in zip(part, self.encode_words([words[i] for i in part])):
                found[i] = x
                if len(words[i]) <= MEMO_WORD_BYTES:
                    young[words[i]] = x
                    self.filled += len(words[i]) + len(x) + ENTRY_BYTES
                if self.filled > MEMO_BYTES:
                    self.old, self.young, self.filled = self.young, {}, 0
                    young = self.young
        return found

    def _ordinary(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts without added tokens, and how many each has."""
        whole = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        pieces = np.cumsum(lengths) - lengths
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        starts = self.starts(points, pieces[lengths > 0])
        data, places = whole.encode(), np.append(starts, len(points))
        if len(data) != len(points):
            places = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80), len(data))[places]
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        ids = self._ids(bytes_of(words.dictionary))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begin = np.frombuffer(b"".join(ids), "<i4"), np.cumsum(sizes) - sizes
        index = words.indices.to_numpy()
        sizes = sizes[index]
        ends = np.cumsum(sizes)
        out = flat[np.repeat(begin[index] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        # Tokens before each text's first word.
        before = np.concatenate(([0], ends))[np.searchsorted(starts, np.append(pieces, len(points)))]
        return out, np.diff(before)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and how many each text has."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            cuts = self.split.split(text) if self.split is not None and any(x in text for x in self.added) else [text]
            for x in cuts:
                more = blocks(x) if len(x) > BLOCK_CHARS else [x]
                parts += more
                owner += [i] * len(more)
        special = [self.added.get(x) for x in parts] if len(parts) > len(texts) else [self.added.get(x) if len(x) < 100 else None for x in parts]
        ids, sizes = self._ordinary(["" if s is not None else x for x, s in zip(parts, special)])
        if any(s is not None for s in special):
            where = np.cumsum(sizes)
            at = [k for k, s in enumerate(special) if s is not None]
            ids = np.insert(ids, where[at], [special[k] for k in at])
            sizes[at] = 1
        return ids, np.bincount(owner, sizes, len(texts)).astype(np.int64)

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of rows of ids, laid end to end, each up to its end."""
        data = self.token_array.take(pa.array(ids))
        places = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4)[np.concatenate(([0], ends))]
        made = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(places.copy()), data.buffers()[2]])
        try:
            return made.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in made.to_pylist()], pa.string())


def bytes_of(column: pa.Array) -> list[bytes]:
    """The values of a binary column without nulls."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).tolist()
    data = column.buffers()[2].to_pybytes()
    return [data[i:j] for i, j in pairwise(ends)]


def blocks(text: str) -> list[str]:
    """A long text in parts that are cut where white space begins, as words are."""
    out, begin = [], 0
    while begin < len(text):
        found = _begins_space.search(text, begin + BLOCK_CHARS)
        end = found.start() + 1 if found else len(text)
        out.append(text[begin:end])
        begin = end
    return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _coded(path: str, text_col: str, keep: list[str]):
    def run(batches):
        own = codec(path)
        for batch in batches:
            column, kept = batch.column(text_col), batch.select(keep)
            begin, texts, chars = 0, [], 0
            for i in range(batch.num_rows):
                texts.append(column[i].as_py() or "")
                chars += len(texts[-1])
                if chars > BATCH_CHARS or i + 1 == batch.num_rows:
                    ids, sizes = own.encode(texts)
                    ends = np.cumsum(sizes)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int32)))
                    columns = [*(kept.column(c).slice(begin, i + 1 - begin) for c in keep), lists, own.decode_all(ids, ends)]
                    yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", "decoded"])
                    begin, texts, chars = i + 1, [], 0
            del column, kept, batch
            give_back()

    return run


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) with ids array<int> and decoded string, read back from the ids.

    path is the place of a byte-level BPE file of the tokenizers library, present on every node.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return bounded(docs).select(*dict.fromkeys([*keep, text_col])).mapInArrow(_coded(path, text_col, keep), schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"), default_path(), keep=["doc_id"])
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op10_bpe": op10_bpe}
ORACLE_SQL: dict[str, str] = {}
