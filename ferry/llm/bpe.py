"""BPE encoding and decoding over a minimal acyclic transducer lexicon.

The corpus' most frequent words (counted over all documents) are compiled,
with the ids that exact merging gives them, into a minimal acyclic automaton:
words share suffixes as well as prefixes, every transition carries the number
of words it skips, and the sum along a path is the word's place in the table
of ids.  The compiled file also holds the merges and the vocabulary; every
executor gets one copy and its workers memory-map it.  Words that the
automaton does not have are merged exactly, many at a time.

The tokenizer is of the kind: NFC, lower case, pieces of letters, single
numerals and other signs, byte-level symbols, a suffix that ends a word.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
import re
import sys
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.llm.shared import bounded_batches, saved

#: Words in the lexicon at most; the others are merged when met.
LEXICON_WORDS = 65_536
#: Counters of a task's frequent-item summary.
COUNTERS = 262_144
#: Chunks whose words are counted at once.
COUNTED_AT_ONCE = 8_192
#: Chunks and words that one worker remembers, twice over (new and old ones).
REMEMBERED = 700_000
#: As many where a lexicon has the frequent words.
REMEMBERED_BESIDE_LEXICON = 100_000
#: Bytes of a word up to which words are merged side by side.
SIDE_BY_SIDE = 48
TEXT_CHUNK = 1 << 20
#: Characters that are encoded and decoded at once.
CODED_AT_ONCE = 1 << 18
NONE = np.int32(1 << 30)


# ------------------------------------------------------------------ words


def _classes() -> tuple[str, str]:
    """Regular-expression ranges of the letters and of the numerals."""
    kinds = "".join(map(itemgetter(0), map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))))
    return tuple("".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in re.finditer(f"{k}+", kinds)) for k in "LN")  # type: ignore[return-value]


#: The white space of Unicode, the contractions of the pieces.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

_SIGNS = frozenset(".,;:!?|")

_PIECES: dict[str, re.Pattern] = {}


def _pieces() -> re.Pattern:
    if "all" not in _PIECES:
        letters, numerals = _classes()
        _PIECES["all"] = re.compile(f"{_CONTRACTIONS}|[{letters}]+|[{numerals}]|[^{_WHITE}{letters}{numerals}]+")
        _PIECES["ascii"] = re.compile(f"{_CONTRACTIONS}|[a-z]+|[0-9]|[^\\t-\\r a-z0-9]+")
    return _PIECES["all"]


def split_words(parts: list[str]) -> list[list[str]]:
    """The pieces of each of ``parts``, which hold no white space and no special token.

    All are composed and lowered at once, a line each: no character composes
    with a line's end.  Characters are lowered one by one: a capital sigma has
    one small form only.
    """
    whole = "\n".join(parts)
    if not whole.isascii():
        whole = unicodedata.normalize("NFC", whole).replace("Σ", "σ")
    # The common cases: letters only, or letters and one sign at the end.
    return [
        [low] if low.isalpha() else [low[:-1], low[-1]] if low[-1:] in _SIGNS and low[:-1].isalpha() else _found(low)
        for low in whole.lower().split("\n")
    ]


def _found(low: str) -> list[str]:
    pattern = _pieces()
    return (_PIECES["ascii"] if low.isascii() else pattern).findall(low)


_NOT_WHITE = re.compile("[\x1c-\x1f]")


def chunks(text: str) -> list[str]:
    """The parts of a text between white space.  No piece crosses one and no
    character composes with one, so a text's ids are those of its chunks."""
    if _NOT_WHITE.search(text):  # signs that str.split takes for white space
        return [c for c in re.split(f"[{_WHITE}]+", text) if c]
    return text.split()


# -------------------------------------------------------------- automaton


def minimal_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct ``words``, as arrays.

    Sorted insertion: the branch that the next word leaves is final, and each
    of its states is merged with an equal one met before.
    """
    edges: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path = [0]
    last = b""

    def settle(depth: int) -> None:
        while len(path) - 1 > depth:
            state = path.pop()
            shape = (final[state], tuple(edges[state].items()))
            same = known.setdefault(shape, state)
            if same != state:
                parent = path[-1]
                edges[parent][last[len(path) - 1]] = same

    for word in words:
        common = os.path.commonprefix([word, last])
        settle(len(common))
        for b in word[len(common) :]:
            edges.append({})
            final.append(False)
            edges[path[-1]][b] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = word
    settle(0)

    order, seen = [0], {0}
    for state in order:  # grows while it is read
        for t in edges[state].values():
            if t not in seen:
                seen.add(t)
                order.append(t)
    number = {s: i for i, s in enumerate(order)}
    below: dict[int, int] = {}

    stack = [(0, False)]
    while stack:
        state, done = stack.pop()
        if done:
            below[state] = final[state] + sum(below[t] for t in edges[state].values())
        elif state not in below:
            stack.append((state, True))
            stack.extend((t, False) for t in edges[state].values() if t not in below)
    keys, targets, skips = [], [], []
    for state in order:
        skip = int(final[state])
        for b, t in sorted(edges[state].items()):
            keys.append(number[state] * 256 + b)
            targets.append(number[t])
            skips.append(skip)
            skip += below[t]
    return {
        "edge": np.array(keys, dtype=np.int64),
        "target": np.array(targets, dtype=np.int32),
        "skip": np.array(skips, dtype=np.int32),
        "final": np.array([final[s] for s in order], dtype=np.uint8),
    }


# ---------------------------------------------------------------- lexicon


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Remembered:
    """Ids of the texts met last: two generations of about ``size`` texts; one
    of the older generation that is met again moves to the newer."""

    def __init__(self, size: int):
        self.size = size
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, met: set[str]) -> set[str]:
        """Those of ``met`` that are not known; the others are in ``new`` then."""
        left = met.difference(self.new)
        again = left & self.old.keys()
        self.new.update(zip(again, map(self.old.__getitem__, again)))
        return left - again

    def age(self) -> None:
        """Begin a generation if the newer one is full."""
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}

    def forget(self) -> None:
        """Know nothing any more."""
        self.new, self.old = {}, {}


class Lexicon:
    """The arrays of a compiled lexicon and the encoding over them."""

    def __init__(self, arrays: dict[str, np.ndarray], special: dict[str, int]):
        self.a = arrays
        self.special = special
        self.stop = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.memory = Remembered(REMEMBERED_BESIDE_LEXICON if len(arrays["edge"]) else REMEMBERED)  # of chunks and words alike: a word is a chunk of that one word
        ends = arrays["name_end"].tolist()
        body = arrays["names"].tobytes()
        self.names = [body[a:b].decode("utf-8") for a, b in zip([0, *ends], ends)]

    # -- compiled file

    @classmethod
    def compiled(cls, tokenizer: str, words: Iterable[str] = ()) -> bytes:
        """The file's content for a tokenizer (its JSON text) and its frequent words."""
        spec = json.loads(tokenizer)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 16) | vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        symbols = _byte_symbols()
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        raw = [names.get(i, "").encode("utf-8") for i in range(max(names) + 1)]
        arrays = {
            "pair": keys[order],
            "rank": order.astype(np.int32),
            "made": made[order],
            "symbol": np.array([vocab[s] for s in symbols], dtype=np.int32),
            "symbol_end": np.array([vocab[s + suffix] for s in symbols], dtype=np.int32),
            "names": np.frombuffer(b"".join(raw), dtype=np.uint8),
            "name_end": np.cumsum([len(x) for x in raw]).astype(np.int64),
        }
        listed = sorted({w.encode("utf-8") for w in words if w})
        arrays |= minimal_automaton(listed)
        bare = cls({**arrays, "ids": np.zeros(0, np.uint32), "ids_end": np.zeros(0, np.int64)}, special)
        ids = bare.merged(listed)
        arrays["ids"] = np.frombuffer(b"".join(ids), dtype=np.uint32)
        arrays["ids_end"] = np.cumsum([len(x) // 4 for x in ids]).astype(np.int64)
        head, body, at = {}, [], 0
        for name, x in arrays.items():
            part = np.ascontiguousarray(x).tobytes()
            head[name] = [x.dtype.str, at, len(x)]
            body.append(part + b"\0" * (-len(part) % 8))
            at += len(body[-1])
        text = json.dumps({"arrays": head, "special": special}).encode()
        text += b" " * (-(len(text) + 8) % 8)
        return len(text).to_bytes(8, "little") + text + b"".join(body)

    @classmethod
    def mapped(cls, path: str) -> "Lexicon":
        """Memory-map a compiled file."""
        whole = np.memmap(path, dtype=np.uint8, mode="r")
        size = int.from_bytes(whole[:8].tobytes(), "little")
        head = json.loads(whole[8 : 8 + size].tobytes())
        arrays = {}
        for name, (kind, at, n) in head["arrays"].items():
            start = 8 + size + at
            arrays[name] = whole[start : start + n * np.dtype(kind).itemsize].view(kind).view(np.ndarray)
        return cls(arrays, head["special"])

    # -- words to ids

    def looked_up(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the table of ids, -1 if it is not there."""
        n, edge = len(words), self.a["edge"]
        place, state = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not len(edge):
            return place - 1
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        start = np.cumsum(sizes) - sizes
        active = np.flatnonzero(sizes > 0)
        state[sizes == 0] = -1
        step = 0
        while len(active):
            key = state[active] * 256 + data[start[active] + step]
            at = np.minimum(np.searchsorted(edge, key), len(edge) - 1)
            found = edge[at] == key
            state[active[~found]] = -1
            active, at = active[found], at[found]
            state[active] = self.a["target"][at]
            place[active] += self.a["skip"][at]
            step += 1
            active = active[sizes[active] > step]
        accepted = (state >= 0) & (self.a["final"][np.maximum(state, 0)] > 0)
        return np.where(accepted, place, -1)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, result) of merging symbols side by side; rank NONE if they don't."""
        pair = self.a["pair"]
        key = (left.astype(np.int64) << 16) | right
        at = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
        ok = (pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.a["rank"][at], NONE), self.a["made"][at]

    def _byte_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(rank, result) of merging two bytes, by the first one and the second
        one's symbol (inside a word, then at its end)."""
        if "of_bytes" not in self.__dict__:
            second = np.concatenate([self.a["symbol"], self.a["symbol_end"]])
            self.of_bytes = self._ranks(np.repeat(self.a["symbol"], 512), np.tile(second, 256))
        return self.of_bytes

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Exact merges: always the pair of lowest rank, the leftmost first."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= SIDE_BY_SIDE]
        short.sort(key=list(map(len, words)).__getitem__)
        for at in range(0, len(short), 8192):
            own = short[at : at + 8192]
            for i, ids in zip(own, self._side_by_side([words[i] for i in own])):
                out[i] = ids
        for i, w in enumerate(words):
            if len(w) > SIDE_BY_SIDE:
                out[i] = self._one_long(w)
        return out

    def _side_by_side(self, words: list[bytes]) -> Iterator[bytes]:
        n, sizes = len(words), np.array([len(w) for w in words])
        width = int(sizes.max())
        columns = np.arange(width)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        sym = self.a["symbol"][raw]
        sym[columns >= sizes[:, None]] = -1
        sym[np.arange(n), sizes - 1] = self.a["symbol_end"][raw[np.arange(n), sizes - 1]]
        sym = np.concatenate([sym, np.full((n, 1), -1, sym.dtype)], axis=1)
        rank, made = np.full((n, width), NONE), np.zeros((n, width), np.int32)
        second = columns[1:] - sizes[:, None]  # from the word's end: -1 is its last byte
        pair = (raw[:, :-1].astype(np.int32) << 9) + raw[:, 1:] + ((second == -1) << 8)
        of_rank, of_made = self._byte_pairs()
        rank[:, :-1] = np.where(second < 0, of_rank[pair], NONE)
        made[:, :-1] = of_made[pair]
        live = np.flatnonzero(rank.min(axis=1) < NONE)
        while len(live):
            s, r, m = sym[live], rank[live], made[live]
            j = r.argmin(axis=1)
            rows = np.arange(len(live))
            s[rows, j] = m[rows, j]
            move = columns + (columns > j[:, None])  # the merged symbol's right half goes
            s = np.concatenate([np.take_along_axis(s, move, axis=1), np.full((len(live), 1), -1, s.dtype)], axis=1)
            move = np.minimum(columns + (columns >= j[:, None]), width - 1)
            r, m = np.take_along_axis(r, move, axis=1), np.take_along_axis(m, move, axis=1)
            r[:, -1] = NONE
            for k in (j - 1, j):
                ok = k >= 0
                at = np.maximum(k, 0)
                new, result = self._ranks(s[rows, at], s[rows, at + 1])
                r[rows[ok], at[ok]] = new[ok]
                m[rows[ok], at[ok]] = result[ok]
            sym[live], rank[live], made[live] = s, r, m
            live = live[r.min(axis=1) < NONE]
        counts = (sym >= 0).sum(axis=1)
        flat = sym[sym >= 0].astype("<u4").tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        return (flat[a:b] for a, b in zip([0, *ends], ends))

    def _one_long(self, word: bytes) -> bytes:
        sym = self.a["symbol"][np.frombuffer(word, dtype=np.uint8)].tolist()
        sym[-1] = int(self.a["symbol_end"][word[-1]])
        if "pairs" not in self.__dict__:
            self.pairs = dict(zip(self.a["pair"].tolist(), zip(self.a["rank"].tolist(), self.a["made"].tolist())))
        after = [*range(1, len(sym)), -1]
        before = list(range(-1, len(sym) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := self.pairs.get((sym[i] << 16) | sym[j])):
                heapq.heappush(heap, (found[0], i, sym[i], sym[j]))

        for i in range(len(sym)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = self.pairs[(a << 16) | b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([s for s in sym if s >= 0], dtype="<u4").tobytes()

    def word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word, little-endian unsigned 32-bit integers."""
        raw = [w.encode("utf-8") for w in words]
        if not len(self.a["edge"]):
            return self.merged(raw)
        place = self.looked_up(raw)
        unseen = np.flatnonzero(place < 0)
        table, ends = memoryview(self.a["ids"]).cast("B"), self.a["ids_end"]
        out = [b""] * len(words)
        for i, ids in zip(unseen.tolist(), self.merged([raw[i] for i in unseen.tolist()])):
            out[i] = ids
        seen = np.flatnonzero(place >= 0)
        to = ends[place[seen]]
        begin = np.where(place[seen] > 0, ends[place[seen] - 1], 0)
        for i, a, b in zip(seen.tolist(), (begin * 4).tolist(), (to * 4).tolist()):
            out[i] = bytes(table[a:b])
        return out

    # -- texts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts (null: empty)."""
        split = [chunks(t or "") for t in texts]
        self.memory.age()
        self._remember(self.memory.missing(set().union(*split)))
        get = self.memory.new.__getitem__
        return [b"".join(map(get, cs)) for cs in split]

    def _remember(self, fresh: set[str]) -> None:
        for name in self.special:
            for c in [c for c in fresh if name in c]:
                self.memory.new[c] = self._with_special(c)
                fresh.discard(c)
        listed = list(fresh)
        pieces = split_words(listed) if listed else []
        unseen = list(self.memory.missing(set().union(*pieces)))
        known = self.memory.new
        known.update(zip(unseen, self.word_ids(unseen)))
        # A chunk of one small word is in the memory by now.
        known.update((c, known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])) for c, ws in zip(listed, pieces) if c != ws[0])

    def _with_special(self, text: str) -> bytes:
        out, at = [], 0
        for m in self.stop.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        out.append(self._plain(text[at:]))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        return b"".join(self.word_ids(split_words([text])[0])) if text else b""

    def decode(self, ids: bytes) -> str:
        """The text of ids: their vocabulary entries, joined by a space."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


# ------------------------------------------------------------------ Spark


def text_chunks(batches: Iterator[pa.RecordBatch], most: int = TEXT_CHUNK) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of batches (id, text) with about ``most`` characters each."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        first, size = 0, 0
        for k, t in enumerate(texts):
            size += len(t or "")
            if size >= most or k == len(texts) - 1:
                yield batch.slice(first, k + 1 - first), texts[first : k + 1]
                first, size = k + 1, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A frequent-item summary of a task's chunks, then of their words.

    When the counters are full, the count of the median counter is taken from
    all and the empty ones go (Misra and Gries): a chunk's count is short by
    at most twice its task's chunks over COUNTERS, and every text is counted.
    """
    found: Counter = Counter()
    for batch in batches:
        for t in batch.column(0):
            if t.is_valid:
                found.update(chunks(t.as_py()))
                if len(found) > COUNTERS:
                    least = int(np.median(np.fromiter(found.values(), np.int64, len(found))))
                    found = Counter({c: n - least for c, n in found.items() if n > least})
    made: Counter = Counter()
    while found:  # a part at a time, which is not held any more then
        some, ns = zip(*(found.popitem() for _ in range(min(len(found), COUNTED_AT_ONCE))))
        for n, words in zip(ns, split_words(list(some))):
            for w in words:
                made[w] += n
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array(list(made.values()), pa.int64())], names=["word", "n"])


def frequent_words(docs: DataFrame, text_col: str = "text", limit: int = LEXICON_WORDS) -> list[str]:
    """The corpus' most frequent words, summed over the summaries of all of
    ``docs``: those from the least count on that at most ``limit`` words reach.

    That count comes from a histogram (counts below 1,024 each, larger ones by
    powers of 2 to the 1/8), so the driver receives some thousand rows of it
    and at most ``limit`` words, whatever the number of partitions.  The choice
    of words saves time and changes no result."""
    bounded_batches(docs.sparkSession)
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "word string, n long")
    counts = saved(counts.groupBy("word").agg(F.sum("n").alias("n")), "words")
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 8) + (1024 - 80)).cast("long")
    least, room = None, limit
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        room -= r["words"]
        if room < 0:
            break
        least = r["step"]
    if least is None:
        return []
    top = counts.where(step >= least).orderBy(F.desc("n"), "word")
    return [r["word"] for r in top.collect()]


def shipped_lexicon(spark: SparkSession, tokenizer_path: str, words: list[str]) -> str:
    """Compile a lexicon and hand it to every executor; its name there.

    One task compiles it (at most LEXICON_WORDS words), which spares the
    driver the memory; the compiled file is a few megabytes.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([Lexicon.compiled(tokenizer, words)], pa.binary())], names=["body"])

    body = bytes(spark.range(1).repartition(1).mapInArrow(compiled, "body binary").first()["body"])
    name = f"lexicon-{hashlib.sha256(body).hexdigest()[:16]}.bin"
    if any(os.path.basename(f) == name for f in spark.sparkContext.listFiles):
        return name  # the same lexicon went out before
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), name)
    with open(path, "wb") as f:
        f.write(body)
    spark.sparkContext.addFile(path)
    return name


_OPEN: dict[str, Lexicon] = {}


def opened(name: str) -> Lexicon:
    """The lexicon in this worker, mapped once."""
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = Lexicon.mapped(SparkFiles.get(name))
    return _OPEN[name]


def _coder(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = opened(name)
        gc.disable()  # no cycles are made here, and passes over millions of words cost a third of the time
        try:
            for part, texts in text_chunks(batches, CODED_AT_ONCE):
                ids = lexicon.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([lexicon.decode(i) for i in ids], pa.large_string()).cast(pa.string())],
                    names=["id", "ids", "decoded"],
                )
        finally:
            # The worker stays, idle or for tasks of other stages: it gives back what this one took.
            lexicon.memory.forget()
            gc.enable()
            pa.default_memory_pool().release_unused()

    return code


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) for every row of ``docs``: token ids of the whole
    text as little-endian unsigned 32-bit integers, and the text decoded from
    these ids.

    Special tokens written out in a text are encoded as such.  Null and empty
    texts have no ids.  Rows are coded one by one, so repeated rows and null
    ids give equal and null-id rows; other columns are ignored.
    """
    spark = docs.sparkSession
    name = shipped_lexicon(spark, tokenizer_path, frequent_words(docs, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_coder(name), "id long, ids binary, decoded string").withColumnRenamed("id", id_col)
