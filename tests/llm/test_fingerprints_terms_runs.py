"""SimHash links, divergence of sources and periodic runs, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ferry.llm import divergence, periodic, simhash
from ferry.llm.divergence import source_divergence
from ferry.llm.periodic import kept_words, periodic_runs, planted, runs_of
from ferry.llm.queries import QUERIES
from ferry.llm.simhash import BKTree, links, simhash_components

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Null and empty texts, ties, repeated rows and ids, a null id, one and two words, columns with names that the operators use.
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 1),
    (3, " \t\n", "en", "b", 2),
    (4, "One", "en", "b", 3),
    (4, "One", "en", "b", 3),
    (5, "one TWO", None, None, 4),
    (6, "Ärger ÄRGER É one\x0btwo\x1cthree x1y2 \x7fend", "de", "a", 5),
    (6, "another text of the same id that has some more words", "de", "a", 5),
    (None, "another text of the same id that has some more words", "de", None, 6),
    (None, None, None, "b", 7),
    (7, "la " * 400 + "end", "", "", 8),
    (8, "tail " + "one two three " * 30, "de", "b", 9),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, fp long"


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, ODD_SCHEMA).selectExpr("*", "fp AS rep", "fp AS component", "fp AS n", "fp AS term", "fp AS runs", "fp AS part")


# ---------------------------------------------------------------- SimHash


def plain_simhash(text: str | None) -> int:
    words = [w.translate(UPPER) for w in re.findall(WORD, text or "")]
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points: dict[int, set[int]], radius: int) -> dict[int, int]:
    """Component of every id, from its fingerprints."""
    least = {i: i for i in points}
    changed = True
    while changed:
        changed = False
        for i in points:
            for j in points:
                if least[j] < least[i] and any((a ^ b).bit_count() <= radius for a in points[i] for b in points[j]):
                    least[i], changed = least[j], True
    return least


def test_simhash_of_odd_rows(spark):
    made = simhash_components(odd(spark))
    assert made.columns == ["doc_id", "fingerprint", "component_id"]
    points: dict[int, set[int]] = {}
    for i, text, *_ in ODD:
        if i is not None:
            points.setdefault(i, set()).add(plain_simhash(text))
    least = plain_components(points, 2)
    by_print = {p: least[i] for i in points for p in points[i]}
    want = [(i, f"{plain_simhash(t):016x}", by_print.get(plain_simhash(t))) for i, t, *_ in ODD]
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(want, key=repr)
    assert simhash_components(odd(spark, [])).collect() == []


def test_simhash_query_against_all_pairs(spark):
    docs = {r["doc_id"]: {plain_simhash(r["text"])} for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    least = plain_components(docs, 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op11_simhash_bk_trees"](spark, SF).collect()}
    assert got == {i: (f"{min(p):016x}", least[i]) for i, p in docs.items()}


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["a", "Bb", "ccc", "d" * 40], k=n)) for n in (1, 2, 3, 4, 50, 300)] + ["", "  x  ", "y" * 500]
    monkeypatch.setattr(simhash, "HELD_SHINGLES", 7)
    for size in (1, 2, 9, 64, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE_BYTES", size)
        assert [simhash.simhash(t.encode()) for t in texts] == [plain_simhash(t) for t in texts]


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_bk_tree_finds_all_points_within_the_radius(radius):
    rng = random.Random(radius)
    points = [0, (1 << 64) - 1] + [rng.getrandbits(64) for _ in range(50)]
    points += [p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for p in points for _ in range(5)]
    tree = BKTree()
    for p in points:
        tree.add(p)
    for p in [*points, rng.getrandbits(64)]:
        assert sorted(tree.near(p, radius)) == [k for k, q in enumerate(points) if (p ^ q).bit_count() <= radius]


def test_a_shard_of_many_parts_loses_no_link(spark):
    # All fingerprints share two blocks, so one shard holds them all: 3 parts, 6 pairs of parts.
    rng = random.Random(9)
    prints = list({rng.getrandbits(14) << 32 for _ in range(2600)})
    frame = spark.createDataFrame([(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)], "rep long, fp long")
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    found = links(frame).collect()
    assert all((prints[r["u"]] ^ prints[r["v"]]).bit_count() <= 2 for r in found)
    # Each pair of parts hands on a spanning forest at most.
    assert len(found) < 6 * 6 * 2 * simhash.PART
    for r in found:
        parent[root(r["u"])] = root(r["v"])
    where = {p: k for k, p in enumerate(prints)}
    for p, k in where.items():
        for a in range(32, 46):
            for b in range(a, 46):
                j = where.get(p ^ 1 << a if a == b else p ^ 1 << a ^ 1 << b)
                assert j is None or root(j) == root(k)


def test_links_refuse_blocks_that_cannot_hold(spark):
    with pytest.raises(ValueError):
        links(spark.createDataFrame([(1, 1)], "rep long, fp long"), radius=4, blocks=4)


# ---------------------------------------------------------------- divergence


def plain_divergence(rows, least: int, top: int) -> list[tuple]:
    docs = [(lang or "", source or "", [t.translate(UPPER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        found = Counter(t for g, _, terms in docs if g == lang for t in set(terms))
        kept = [t for t, n in found.items() if n >= least]
        groups = {s: Counter(t for g, x, terms in docs if (g, x) == (lang, s) for t in terms if found[t] >= least) for g, s, _ in docs if g == lang}

        def shares(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        whole = shares(sum(groups.values(), Counter()))
        p = {s: shares(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(whole[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > whole[t]]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(sorted(terms)[:top])]
    return out


@pytest.mark.parametrize("least, top", [(1, 50), (2, 3), (100, 5)])
def test_divergence_of_odd_rows(spark, least, top):
    made = source_divergence(odd(spark), least_documents=least, top_terms=top)
    assert made.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, made.collect())) == sorted(plain_divergence(ODD, least, top))
    assert source_divergence(odd(spark, [])).collect() == []


def test_divergence_with_ties_and_many_groups(spark):
    rng = random.Random(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["é", "z", "Ωmega", "\U0001f600"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 30))), rng.choice(["x", "y"]), f"s{rng.randrange(6)}", 0) for k in range(300)]
    rows += [(k, " ".join(words), "tie", f"s{k % 3}", 0) for k in range(9)] + [(999, "", "tie", "none", 0)]
    got = source_divergence(odd(spark, rows), least_documents=3, top_terms=4).collect()
    assert sorted(map(tuple, got)) == sorted(plain_divergence(rows, 3, 4))


def test_terms_are_whole_across_pieces(monkeypatch):
    text = "Abc dé'f ÄÖ-x y9z  " * 5 + "q" * 90 + " end"
    want = [t.translate(UPPER).encode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
    for size in (1, 2, 3, 10, 64, 1000):
        monkeypatch.setattr(divergence, "PIECE_BYTES", size)
        assert [t for piece in divergence.terms_of(text.encode()) for t in piece] == want


# ---------------------------------------------------------------- periodic runs


def plain_runs(x: list, least_words: int = 24, least_power: int = 3) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, len(x) // least_power + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            part = x[i : j + q]
            if j > i and len(part) >= max(least_words, least_power * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def repetitive(rng: random.Random) -> list[int]:
    x: list[int] = []
    size = rng.randint(10, 400)
    while len(x) < size:
        kind = rng.random()
        if kind < 0.4 and x:  # repeat a part of what is there
            a = rng.randrange(len(x))
            x += x[a : a + rng.randint(1, 70)] * rng.randint(1, 5)
        elif kind < 0.7:
            x += [rng.randint(0, 1)] * rng.randint(1, 30)
        else:
            x = x * rng.randint(1, 3) + [rng.randint(0, 2) for _ in range(rng.randint(1, 20))]
    return x[:800]


def test_runs_equal_brute_force():
    rng = random.Random(11)
    seen = 0
    for _ in range(800):
        x = repetitive(rng)
        want = plain_runs(x)
        seen += len(want)
        assert runs_of(np.array(x)) == want
    assert seen > 1000


@pytest.mark.parametrize("period", [1, 2, 7, 8, 9, 15, 16, 17, 24, 31, 32, 33, 64, 65])
def test_runs_of_least_length_at_the_edges_of_the_classes(period):
    length = max(24, 3 * period)
    for size, found in ((length, 1), (length - 1, 0)):
        x = [-1, -2, *(k % period for k in range(size)), -3]
        assert runs_of(np.array(x) + 3) == ([(2, size, period)] if found else [])


def test_a_very_long_repeating_text_takes_time_in_proportion():
    # Pairs of all occurrences would be 10 ** 10 here.
    assert runs_of(np.arange(300_000) % 2) == [(0, 300_000, 2)]
    assert runs_of(np.array(([0] * 50 + [1]) * 4000))[-1] == (51 * 3999, 50, 1)


def plain_row(doc_id, text) -> tuple:
    words = re.findall(WORD, text or "")
    n = len(words)
    h = crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join("%d,%d,%d\n" % r for r in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digest)


def test_periodic_query_equals_brute_force(spark):
    made = QUERIES["op13_periodic_runs"](spark, SF)
    assert made.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"]) < 9000]
    got = {r["doc_id"]: tuple(r) for r in made.collect()}
    assert len(docs) > 150 and sum(got[r["doc_id"]][1] > 0 for r in docs) > 5
    for r in docs:
        assert got[r["doc_id"]] == plain_row(r["doc_id"], r["text"])


def test_periodic_runs_of_odd_rows(spark):
    made = periodic_runs(odd(spark))
    assert made.columns == ["doc_id", "words", "runs", "collapsed"]
    want = []
    for i, text, *_ in ODD:
        words = re.findall(WORD, text or "")
        runs = plain_runs(words)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        want.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    got = [(r["doc_id"], r["words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in made.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic_runs(odd(spark, [])).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(odd(spark), least_words=10)


def test_planted_tail_and_kept_words():
    words = np.arange(50)
    changed = next(i for i in range(1000) if crc32(str(i).encode()) % 10 == 0)
    assert planted(None, words) is words and planted(changed, words[:0]).size == 0
    assert planted(changed, words).size == 50
    assert kept_words(7, [(1, 4, 1), (3, 3, 1)]).tolist() == [True, True, False, False, False, False, True]


def test_words_are_whole_across_pieces(monkeypatch):
    text = "ab c  ddd\x0beé f" * 6 + "g" * 50
    want = re.findall(WORD, text)
    for size in (1, 2, 5, 40, 1000):
        monkeypatch.setattr(periodic, "PIECE_BYTES", size)
        numbers, names = periodic.numbered_words(text.encode())
        assert [names[k].decode() for k in numbers] == want


def test_a_task_gives_one_row_for_each_term_of_a_group():
    rows = [("b a a", "en", "x"), ("a", "en", "x"), ("A c", "en", "y"), (None, None, "y"), ("", "en", None)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["text", "lang", "source"])
    got = [tuple(r.values()) for b in divergence._tally(iter([batch])) for r in b.to_pylist()]
    want = [("en", "x", "", 2, 2), ("en", "x", "a", 3, 2), ("en", "x", "b", 1, 1), ("en", "y", "", 1, 1), ("en", "y", "a", 1, 1), ("en", "y", "c", 1, 1), ("", "y", "", 1, 1), ("en", "", "", 1, 1)]
    assert sorted(got) == sorted(want)
