"""The training-data operators against brute force on small tables, and their defined results."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from moraine.llm import decontaminate, graph, htmltext, linedup, mixing, neardup, quality, quotes, rangecoder, substring, tokens, warc
from moraine.llm.hashing import WordHashes, hashes_of, shingles, units

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}x" for _ in range(n)]


def _corpus():
    rng, rows = random.Random(7), []
    for i in range(40):
        rows.append(" ".join(_words(rng, rng.choice([3, 40, 120, 300]), 4000)))
    base = _words(rng, 150, 9000)
    for k in range(6):  # near copies of one text
        words = list(base)
        for _ in range(k % 3):
            words[rng.randrange(150)] = f"n{rng.random()}"
        rows.append(" ".join(words))
    passage = " ".join(_words(rng, 60, 9000))
    rows += [f"alpha beta {passage} gamma", f"one two three {passage}", f"delta {passage} rest of it here"]
    rows += [rows[0], rows[5], rows[5], "", "   \n ", None, "few words", "few words", "Nd " * 90, "a%%% b### c*** " * 40, "WHAT!! IS!! THIS!! " * 30, "long " + "word" * 50_000]
    return [(i, x, "en", ["s1", "s2", None, "s0"][i % 4], len(x or "")) for i, x in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_corpus(), SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and sources, repeated rows, and columns with names that operators use inside."""
    rows = [(None, "no id here at all", 1, 2, "x"), (None, None, None, None, None), (3, "same row twice, the very same", 1, 2, "y"), (3, "same row twice, the very same", 1, 2, "y"), (4, "", 5, 6, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, id long, kept long, source string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _multiset(text):
    words = (text or "").encode().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def test_near_dedup_finds_the_components(docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: _multiset(t) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            if b < a and sets[a] and sets[b]:
                common = (sets[a] & sets[b]).total()
                if common >= 0.8 * (sets[a].total() + sets[b].total() - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == {i: find(i) for i in rows}


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(1)
    a = [b"%d" % rng.randrange(10**6) for _ in range(400)]
    b = a[:300] + [b"%d" % rng.randrange(10**6) for _ in range(100)]
    known = WordHashes()
    sets = [units(shingles(known.of(x))) for x in (a, b, a[:2], [])]
    got = neardup.signatures(sets, 2000)
    true = neardup.weighted_jaccard(sets[0], sets[1])
    assert abs((got[0] == got[1]).mean() - true) < 0.05 and (got[2] != neardup.MAX).all() and (got[3] == neardup.MAX).all()
    assert (neardup.signatures([sets[1]], 2000)[0] == got[1]).all()


def test_leftover_links_join_what_hubs_do_not():
    import pyarrow as pa

    base = [f"t{i}" for i in range(200)]
    texts = [" ".join(base), " ".join(base[:190] + ["a"] * 1 + base[191:]), " ".join(f"u{i}" for i in range(200))]
    table = pa.table({"id": pa.array([1, 2, 3]), "text": texts})
    out = neardup._links_within(table, table)
    assert out.to_pylist() == [{"a": 1, "b": 2}]


def _least_of_component(edges):
    root = {x: x for edge in edges for x in edge}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components_of_chains_and_overlapping_hubs(spark):
    rng, nodes = random.Random(3), iter(random.Random(3).sample(range(10**6), 4000))
    groups = []
    for n in (2, 5, 9, 30, 60):
        chain = [next(nodes) for _ in range(n)]
        groups.append(list(zip(chain, chain[1:])))
    for _ in range(40):  # hubs in a row, each with a member that the next one has too
        edges, shared = [], next(nodes)
        for _ in range(rng.randrange(2, 6)):
            hub, members = next(nodes), [next(nodes) for _ in range(rng.randrange(1, 5))]
            edges += [(hub, x) for x in [shared, *members]]
            shared = members[-1]
        groups.append(edges)
    for n, edges in enumerate(([(1, 5), (5, 3), (3, 6), (6, 2)], [x for group in groups for x in group])):
        got = graph.components(spark.createDataFrame(edges, "a long, b long"), f"{spark.conf.get('spark.checkpoint.dir')}/graph-test-{n}").collect()
        assert sorted(map(tuple, got)) == sorted(_least_of_component(edges).items())


def test_near_dedup_of_overlapping_hubs_has_one_row_a_document(spark, monkeypatch):
    texts = {i: " ".join(f"t{i}w{n}" for n in range(60)) for i in (1, 2, 3, 5, 6)}
    edges = spark.createDataFrame([(1, 5), (3, 5), (3, 6), (2, 6)], "a long, b long")
    node = lambda nodes, x: nodes.select(F.col("id").alias(x), F.col("node").alias(f"{x}_node"))
    monkeypatch.setattr(neardup, "_leftover_links", lambda members, links, hubs, nodes, *_: edges.join(node(nodes, "a"), "a").join(node(nodes, "b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in neardup.classes(rows).collect()) == [(i, 1) for i in sorted(texts)]
    assert [r.doc_id for r in neardup.keep_one(rows).collect()] == [1]


def test_near_dedup_defined_results(docs, odd, empty):
    assert neardup.classes(empty).count() == 0
    got = [(r.doc_id, r.class_id) for r in neardup.classes(odd).collect()]
    assert sorted(got, key=str) == [(3, 3), (3, 3), (4, 4), (None, None), (None, None)]
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 4
    assert neardup.keep_one(docs).count() < docs.count() and neardup.keep_one(empty).columns == empty.columns


def test_near_dedup_tells_null_and_equal_ids_apart(spark):
    a, b, c = (" ".join(f"{x}{n}" for n in range(200)) for x in "abc")
    near = a.replace("a100 ", "other ")
    rows = [(5, a), (5, b), (5, b), (9, near), (None, b), (None, c), (None, c), (2, near), (None, None), (7, " "), (7, " ")]
    table = spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, node string, head int")
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(table).collect()), key=str)
    want = [(5, 2), (5, 5), (5, 5), (9, 2), (None, 5), (None, None), (None, None), (2, 2), (None, None), (7, 7), (7, 7)]
    assert got == sorted(want, key=str)
    kept = neardup.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, near), (5, b), (None, c), (None, None), (7, " "), (7, " ")], key=str)


def test_quality_rules(docs, odd, empty):
    got = {r.doc_id: r for r in quality.query(docs).collect()}
    for r in docs.collect():
        text = r.text or ""
        words = WORDS.findall(text)
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        hit = {i + k for i in range(len(words) - 2) for k in range(3) if grams[tuple(words[i : i + 3])] > 1}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_repeat_words, x.n_dup_lines) == (len(words), sum(map(len, words)), len(hit), len(lines) - len(set(lines)))
        assert x.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
        assert not (x.base_failed and x.kept)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(x.kept for i, x in got.items() if texts[i].startswith("w") and not x.base_failed)
    assert not any(x.kept for i, x in got.items() if "%%%" in texts[i] or "!!" in texts[i])
    rules = [*quality.base_rules(), *quality.default_rules(quality._inline())]
    assert {r.name for r in quality.order_rules(docs, rules)} == {r.name for r in rules}
    kept = sorted((r.doc_id for r in quality.keep_good(docs).collect()))
    assert kept == sorted(i for i, x in got.items() if x.kept) and len(kept) > 5
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(empty).count() == 0
    assert quality.query(empty).count() == 0 and quality.judge(odd).count() == 5
    assert quality.keep_good(docs.withColumn("n_words", F.lit("mine"))).select("n_words").distinct().first()[0] == "mine"


def _repeated_words(rows):
    """The numbers of the words of each (id, text) that stand in a line, paragraph or run of fifty words which occurs earlier."""
    first, gone = {}, {}
    for i, text in rows:
        gone[i] = set()
        lines, at = [], 0
        for line in (text or "").encode().lower().split(b"\n"):
            words = line.split()
            lines.append((at, words))
            at += len(words)
        blocks = [(k, w, "line") for k, w in lines]
        for k, (at, words) in enumerate(lines):
            if words and (k == 0 or not lines[k - 1][1]):
                block = [words]
                while k + len(block) < len(lines) and lines[k + len(block)][1]:
                    block.append(lines[k + len(block)][1])
                if len(block) > 1:
                    blocks.append((at, [w for x in block for w in x], tuple(map(len, block))))
        words = [w for _, x in lines for w in x]
        for k, w, kind in blocks:
            if len(w) >= 15 and first.setdefault((kind, tuple(w)), (i, k)) != (i, k):
                gone[i].update(range(k, k + len(w)))
        for p in range(len(words) - 49):
            doc, at = first.setdefault(tuple(words[p : p + 50]), (i, p))
            if doc != i or p >= at + 50:
                gone[i].update(range(p, p + 50))
    return gone


def test_substring_dedup(spark, docs, odd, empty):
    rng = random.Random(41)
    pool = [" ".join(_words(rng, n, 9000)) for n in (3, 14, 15, 16, 30, 60)]
    more = [(1000 + i, "\n".join(rng.choice([*pool, "", " ".join(_words(rng, 20, 9000))]).replace(" ", rng.choice([" ", "  ", "\t"])) for _ in range(8)), "en", "s", 1) for i in range(25)]
    table = docs.union(spark.createDataFrame(more, SCHEMA))
    rows = sorted((r.doc_id, r.text) for r in table.collect())
    want = _repeated_words(rows)
    got = {r.doc_id: r for r in substring.dedup(table).collect()}
    texts = dict(rows)
    for i, gone in want.items():
        assert got[i].n_removed_words == len(gone)
        left = [w for k, w in enumerate(WORDS.findall(texts[i] or "")) if k not in gone]
        assert WORDS.findall(got[i].text or "") == left
        removed = "".join(texts[i][a:z] for a, z in zip(got[i].removed_starts, got[i].removed_ends))
        assert len(removed) == len(texts[i] or "") - len(got[i].text or "")
    assert sum(map(bool, want.values())) >= 15 and substring.dedup(empty).count() == 0 and substring.dedup(odd).count() == 5


def test_substring_dedup_inside_one_document(spark):
    rng = random.Random(21)
    passage, own = " ".join(_words(rng, 60, 9000)), [" ".join(_words(rng, 30, 9000)) for _ in range(12)]
    rows = [
        (1, f"{own[0]} {passage} {own[1]} {passage}\n{passage} {own[2]}"),
        (2, f"{own[3]} {passage} {own[4]} {passage}"),
        (3, f"{own[5]} {own[6]} " * 3 + own[7]),
        (4, f"{own[8]} " * 20),
        (5, "a b c " * 40),
        (6, own[9]),
    ]
    first = {}
    got = {r.doc_id: r for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words, gone = text.split(), set()
        for p in range(len(words) - 49):
            doc, at = first.setdefault(tuple(words[p : p + 50]), (i, p))
            if doc != i or p >= at + 50:
                gone.update(range(p, p + 50))
        assert (i, got[i].n_removed_words, got[i].text.split()) == (i, len(gone), [w for k, w in enumerate(words) if k not in gone])
    assert [got[i].n_removed_words for i in (1, 2, 3, 6)] == [120, 120, 120, 0] and got[4].n_removed_words > 500


def test_substring_dedup_tells_equal_ids_apart(spark):
    rng = random.Random(22)
    passage, x, y = (" ".join(_words(rng, 70, 9000)) for _ in range(3))
    rows = [(1, f"{x} {passage}"), (1, f"{passage} {y}"), (2, x), (2, x)]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed_words) for r in got) == [(1, 0), (1, 70), (2, 70), (2, 70)]
    assert {w for r in got for w in r.text.split()} == {w for _, t in rows for w in t.split()}


def test_substring_dedup_of_lines_and_paragraphs(spark):
    rows = [(1, "A line\nother\n\na  LINE"), (2, "a line\nnew\n\n\nA Line\n other"), (3, None), (None, "x y\nnew\nother"), (None, "new\nx y"), (4, "")]
    table = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, row string")
    got = {(r.doc_id, r.text): (list(r.removed_starts), list(r.removed_ends), r.n_removed_words) for r in substring.dedup(table, least=1).collect()}
    assert got[1, "A line\nother\n\n"] == ([14], [21], 2) and got[3, None] == ([], [], 0) and got[4, ""] == ([], [], 0)
    assert got[2, "\nnew\n\n\n"] == ([0, 13], [6, 26], 5)
    # Of the two rows without an id the one with the smaller text hash keeps "x y"; "new" and "other" stand in earlier documents.
    assert sorted(x[2] for (i, _), x in got.items() if i is None) in ([1, 4], [2, 3])
    assert [x[:2] for x in substring.units(b"a b\nc\n\nd e\n", 2)] == [(0, 2), (0, 3), (3, 2)]


def _line_matches(rows):
    lines = [(i, k, frozenset(WORDS.findall(x))) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    lines = sorted(x for x in lines if x[2])
    gone = {}
    for n, (i, k, s) in enumerate(lines):
        if any(len(s & o) * 9 >= 4 * (len(s) + len(o)) for _, _, o in lines[:n]):
            gone.setdefault(i, []).append(k)
    return gone


def test_line_dedup(spark, odd, empty):
    rng = random.Random(5)
    pool = [_words(rng, rng.choice([1, 2, 5, 10, 30, 150]), 300) for _ in range(25)]
    crowd = _words(rng, 40, 5000)
    rows = []
    for i in range(60):
        lines = []
        for _ in range(4):
            words = list(rng.choice(pool))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(50)}"
            lines.append(" ".join(words))
        words = list(crowd)
        words[rng.randrange(40)] = f"c{i}"
        rows.append((i, "\n".join([*lines, "", "\t".join(words)])))
    got = {r.doc_id: r for r in linedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = _line_matches(rows)
    assert {i: list(r.removed) for i, r in got.items() if r.removed} == want
    for i, text in rows:
        assert got[i].text == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want.get(i, []))
    assert linedup.query(empty).count() == 0 and linedup.query(odd).count() == 5


def test_line_dedup_tells_null_and_equal_ids_apart(spark):
    rng = random.Random(31)
    a, b, c = ("\n".join(" ".join(_words(rng, 12, 9000)) for _ in range(3)) for _ in range(3))
    near = a.split("\n")[0].split()
    near[0] = "other"
    rows = [(1, a), (None, a), (None, b), (5, a), (5, c), (5, c), (6, " ".join(near) + "\n" + c), (None, None), (7, ""), (8, "x" * 200_000 + " y")]
    table = spark.createDataFrame([(*r, 1, "a", 2) for r in rows], "doc_id long, text string, id long, row string, nth int")
    got = sorted((str(r.doc_id), str(r.text), list(r.removed)) for r in linedup.dedup(table).collect())
    want = [(1, a, []), (None, "", [0, 1, 2]), (None, b, []), (5, "", [0, 1, 2]), (5, c, []), (5, c, []), (6, "", [0, 1, 2, 3]), (None, None, []), (7, "", []), (8, rows[-1][1], [])]
    assert got == sorted((str(i), str(t), r) for i, t, r in want)


def test_line_sets_take_little_memory():
    """The arrays of a worker are bounded by a slice of its texts, and slices change no line."""
    rng = random.Random(8)
    texts = ["\n".join(" ".join(_words(rng, 12, 20_000)) for _ in range(400)) for _ in range(300)]
    ids = pa.array(range(len(texts)), pa.int64())
    whole = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["id", "row", "text"])
    held = SimpleNamespace(value=(np.empty(0, np.uint64), np.empty(0, np.int64)))
    tracemalloc.start()
    seen = sum(x.num_rows for x in linedup._lines(held)(iter([whole])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 120_000 and peak < 50 << 20


def test_word_counts_of_a_task_take_bounded_rows(spark):
    """A task sends its counters once, whatever it has read, and no count is below the true one."""
    words = [f"w{n}" for n in range(150_000)]
    texts = [" ".join(words[a : a + 500]) for a in range(0, len(words), 500)] * 2 + ["often " * 5000, None, "", "often\tw7\n"]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a : a + 40])], ["text"]) for a in range(0, len(texts), 40)]
    rows = sum(x.num_rows for x in linedup._count(iter(batches)))
    assert rows < 200_000 < 2 * len(words)
    one, two = linedup.word_counters(spark.createDataFrame([(x,) for x in texts], "text string").repartition(3))
    assert one.sum() == two.sum() == 2 * 150_000 + 5002
    at = linedup._counters(hashes_of(pa.array([*words, "often"])))
    least = np.minimum(one[at[0]], two[at[1]])
    assert (least[:-1] >= 2).all() and 5001 <= least[-1] < 5030


def test_line_sets_take_little_time_beyond_splitting():
    """Sets are made by sorting: the hash tables of np.unique took more than all of the rest."""
    rng = random.Random(9)
    texts = pa.array(["\n".join(" ".join(_words(rng, 50, 20_000)) for _ in range(20)) for _ in range(150)])
    one = np.ones(linedup.COUNTERS, np.int64)

    def least(make):
        took = []
        for _ in range(9):
            began = time.process_time()
            make()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: linedup.line_sets(texts, one, one)) < 3.8 * least(lambda: linedup._split(texts))


def test_line_matches_share_an_indexed_word():
    """Of two matching lines, the prefix of the longer one has one of the words that the shorter one is looked up by."""
    rng, pool, lines = random.Random(12), [f"p{n}" for n in range(300)], []
    for _ in range(60):
        base = rng.sample(pool, rng.randrange(1, 60))
        lines += [rng.sample(base, max(1, len(base) - rng.randrange(12))) + rng.sample(pool, rng.randrange(4)) for _ in range(6)]
    counts = np.random.default_rng(3).integers(1, 9, (2, linedup.COUNTERS))
    _, nth, sets = linedup.line_sets(pa.array(["\n".join(" ".join(x) for x in lines)]), *counts)
    assert nth.tolist() == list(range(len(lines)))
    whole, indexed, seen = [set(x) for x in lines], [], 0
    for n, prefix in zip(sets.column("n").to_pylist(), sets.column("prefix").to_pylist()):
        indexed.append({w for at, w in enumerate(prefix) if eval(linedup._INDEXED)})
        assert len(indexed[-1]) == n - (8 * n + 8) // 9 + 1
    for i, x in enumerate(whole):
        for j, y in enumerate(whole):
            if i != j and len(y) <= len(x) and 9 * len(x & y) >= 4 * (len(x) + len(y)):
                seen += 1
                assert indexed[j] & set(sets.column("prefix")[i].as_py())
    assert seen > 100


def test_line_dedup_of_crowds_of_other_lengths(spark, monkeypatch):
    """Crowds of lines of unequal lengths, the shorter or the longer one first."""
    monkeypatch.setattr(linedup, "CROWD", 4)
    rng, rows = random.Random(14), []
    pools = [_words(rng, n, 5000) for n in (3, 6, 11, 25, 60)]
    for i in range(50):
        lines = []
        for words in pools:
            some = [x for x in words if rng.random() < 0.93]
            lines.append(" ".join([*some, *(f"{i % 7}x{k}" for k in range(rng.randrange(max(2, len(words) // 8))))]))
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: list(r.removed) for r in linedup.query(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.removed}
    assert got == _line_matches(rows) and 100 < sum(map(len, got.values())) < 250


def test_counters_tell_rare_words_apart(spark):
    """Counters of all tasks are summed in blocks, and most of 400 000 words have counts of their own."""
    words = [f"w{n}" for n in range(400_000)]
    texts = [" ".join(words[a : a + 1000]) for a in range(0, len(words), 1000)]
    assert sum(x.num_rows for x in linedup._count(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))) <= 1024
    one, two = linedup.word_counters(spark.createDataFrame([(x,) for x in [*texts, *texts[:10], None]], "text string").repartition(5))
    at = linedup._counters(hashes_of(pa.array(words)))
    least = np.minimum(one[at[0]], two[at[1]])
    assert one.sum() == two.sum() == 410_000 and (least[:10_000] >= 2).all() and least.min() == 1 and least[10_000:].mean() < 1.6


def test_word_hashes_of_arrays():
    import pyarrow as pa

    words = ["", "a", "b", "ab", "ba", "é", "x" * 3000, "x" * 2999, "a"]
    got = hashes_of(pa.array(words)).tolist()
    assert got[1] == got[8] and len(set(got)) == 8
    assert hashes_of(pa.array(["zz", *words]).slice(1)).tolist() == got and len(hashes_of(pa.array([], pa.string()))) == 0


CHAT = "conv_id long, turn long, role string, text string"


def test_chat_quotes(spark):
    rows = [(1, 0, "user", "Hello there\nhow are you"), (1, 1, "a", "> Hello  there\nfine thanks"), (1, 2, "user", "A wrote:\n> fine thanks\n>> hello THERE\nok good"), (1, 3, "a", "nothing"), (1, 4, "b", ">> Hello there\nlate"), (None, 0, "x", "Hello there"), (2, None, "y", None), (2, 1, "z", "> Hello there\nzz"), (2, 1, "z", "> Hello there\nzz")]
    table = spark.createDataFrame([(*r, 7, "mine", 1) for r in rows], CHAT + ", reply_to long, n_linked string, thread int")
    out = quotes.format_chats(table).collect()
    got = {(r.conv_id, r.turn): (r.text, r.reply_to, r.thread, r.depth) for r in out}
    assert len(out) == 9
    assert got[1, 1] == ("fine thanks", 0, 0, 1) and got[1, 2] == ("ok good", 1, 0, 2) and got[1, 4] == ("late", 0, 0, 1)
    assert got[1, 3] == ("nothing", None, 3, 0) and got[2, 1] == ("zz", None, 1, 0) and got[2, None] == ("", None, None, 0)
    threads = {(r.conv_id, r.thread): [(m.turn, m.text) for m in r.messages] for r in quotes.conversations(table).collect()}
    assert threads[1, 0] == [(0, "Hello there\nhow are you"), (1, "fine thanks"), (2, "ok good"), (4, "late")] and threads[1, 3] == [(3, "nothing")] and threads[2, None] == [(None, "")] and len(threads[2, 1]) == 2
    empty = spark.createDataFrame([], CHAT)
    assert quotes.format_chats(empty).count() == 0 and quotes.conversations(empty).count() == 0


def test_chat_quotes_of_generated_threads(spark):
    """Chains and trees of replies whose quotes are wrapped anew, nested and mixed with quotes of nothing."""
    duckdb = pytest.importorskip("duckdb")
    rng, rows, want = random.Random(51), [], {}
    for c in range(25):
        bodies = {}
        for t in range(rng.randrange(1, 9)):
            lines = [" ".join(_words(rng, rng.randrange(3, 9), 9000)) for _ in range(rng.randrange(1, 4))]
            parent = rng.choice([None, *bodies])
            said = list(lines)
            if parent is not None:
                words = " ".join(bodies[parent]).split()
                cut = rng.randrange(1, len(words) + 1)
                said = [f"{rng.choice(['A', 'Bo'])} wrote:", *(f"{rng.choice(['> ', '>', '  > '])}{' '.join(x).upper()}" for x in (words[:cut], words[cut:]) if x), *said]
            if rng.random() < 0.4:
                said = ["> " + " ".join(_words(rng, 4, 9000)), "", *said]
            bodies[t] = lines
            rows.append((c, t, "u", "\n".join(said)))
            want[c, t] = (parent, t if parent is None else want[c, parent][1], 0 if parent is None else want[c, parent][2] + 1, "\n".join(lines))
    rows += [(100, 0, "u", "thanks\nmore here"), (100, 1, "u", "thanks"), (100, 2, "u", "> thanks\n> more here\nyes"), (100, 3, "u", ">> more\n>> here\n>\n> yes\n" + "long " * 100_000)]
    table = spark.createDataFrame(rows, CHAT)
    out = quotes.format_chats(table).collect()
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth, r.text) for r in out}
    assert {k: v for k, v in got.items() if k[0] < 100} == want
    assert got[100, 1][0] is None and got[100, 2][:3] == (0, 0, 1) and got[100, 3][:3] == (2, 0, 2)
    db = duckdb.connect()
    db.register("conversations", table.toArrow())
    names = ["conv_id", "turn", "role", "text", "n_quoted", "n_linked", "reply_to", "thread", "depth"]
    assert sorted(map(str, db.sql(quotes.ORACLE).select(", ".join(names)).fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in out)


def test_chat_quotes_of_long_runs(spark):
    """Quotes of five and more lines from inside longer paragraphs, wrapped anew, with lines and beginnings that many messages share."""
    duckdb = pytest.importorskip("duckdb")
    rng, rows, want = random.Random(52), [], {}
    shared = [" ".join(_words(rng, 5, 9000)) for _ in range(6)]
    for c in range(12):
        bodies = {}
        for t in range(8):
            body = [" ".join(_words(rng, rng.randrange(1, 9), 9000)) for _ in range(rng.randrange(9, 30))]
            body[3:3] = shared  # all messages have these; only what follows tells them apart
            if c % 3 == 0:
                body = [x.replace("w", "Ж\t") for x in body]
            said, parent = list(body), None
            if t and rng.random() < 0.8:
                parent = rng.randrange(t)
                a = rng.choice([0, 1, 2, 3, 9])
                words = " ".join(bodies[parent][a : a + rng.randrange(7, 12)]).split()
                cut = rng.randrange(1, len(words))
                said = [f"> {' '.join(words[:cut])}", f">{' '.join(words[cut:])}", "", *body]
            bodies[t] = body
            want[c, t] = parent
            rows.append((c, t, "u", "\n".join(said)))
    # A run that ends within a line is none; lines all alike are quoted by number.
    rows += [(50, 0, "u", "\n".join(f"line {i} of it" for i in range(20))), (50, 1, "u", "> " + " ".join(f"line {i} of it" for i in range(2, 9)) + " line"), (50, 2, "u", "> " + " ".join(f"line {i} of it" for i in range(2, 9)))]
    rows += [(51, 0, "u", "\n".join(["ha"] * 7)), (51, 1, "u", "\n".join(["ha"] * 400)), (51, 2, "u", "> " + "ha " * 300), (51, 3, "u", "> " + "ha " * 6)]
    want |= {(50, 0): None, (50, 1): None, (50, 2): 0, (51, 0): None, (51, 1): None, (51, 2): 1, (51, 3): 0}
    table = spark.createDataFrame(rows, CHAT)
    out = quotes.format_chats(table).collect()
    assert {(r.conv_id, r.turn): r.reply_to for r in out} == want
    db = duckdb.connect()
    db.register("conversations", table.where("conv_id <> 51").toArrow())
    names = ["conv_id", "turn", "role", "text", "n_quoted", "n_linked", "reply_to", "thread", "depth"]
    whole = quotes.ORACLE.replace("range(1, 5)", "range(1, 60)")  # the SQL, without its bound on the lines of a run
    assert whole != quotes.ORACLE
    assert sorted(map(str, db.sql(whole).select(", ".join(names)).fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in out if r.conv_id != 51)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_decontamination(spark, broadcast):
    rng = random.Random(9)
    items = [(1, " ".join(_words(rng, 25, 60))), (2, "Short Item, here"), (3, None), (4, "Ünï CÖDE words"), (10, "short item here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    piece = items[0][1].split()
    texts = [" ".join(["before", *piece[3:15], "after"]), "a SHORT item here and short-item-here", "ünï cöde words", "Ünï cÖde words", "Ünï CÖDE WORDS", None, "", " ".join(piece[:9]), " ".join(piece * 2)]
    docs = spark.createDataFrame([(i if i != 8 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    wins = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - 9)):
            if w:
                wins.setdefault(tuple(w[p : p + 10]), set()).add(str(i))
    for r in decontaminate.flag(docs, bench, broadcast_windows=broadcast).collect():
        w = words(texts[8 if r.doc_id is None else r.doc_id])
        hit, found = set(), set()
        for win, of in wins.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    found |= of
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    clean = {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()}
    assert clean == {2, 5, 6, 7} - ({2} if any(words(texts[2]) == list(x) for x in wins) else set())
    assert decontaminate.flag(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.flag(docs.where("false"), bench).count() == 0


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_decontamination_folds_words_alike_everywhere(spark, broadcast):
    rng = random.Random(17)
    letters = ["\u03b1\u03a3", "\u03a3", "\u03c2", "\u0392", "\u0130", "I", "i", "\u212a", "K", "k", "\u1e9e", "\u00df", "\u01c5", "x", "X", "\u0307", "\u00e9", "E\u0301", "\U00010400", "7"]
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 4)))
    items = [(0, "\u0391\u03a3")] + [(i, " ".join(word() for _ in range(rng.randrange(1, 4)))) for i in range(1, 40)]
    texts = ["x \u0391\u03a3.\u0392 y", "x \u0391\u03a3"] + [rng.choice([" ", ".", "-", "'"]).join([word(), rng.choice(items)[1].replace(" ", rng.choice([" ", ". ", "'"])), word()]) for _ in range(80)]
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    rows = [(i, t, "mine", 1) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, window string, start int")
    got = decontaminate.flag(docs, spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=broadcast).collect()
    assert len(got) == len(rows)
    for r in got:
        w, hit, found = fold(texts[r.doc_id]), set(), set()
        for i, t in items:
            v = fold(t)
            for p in range(len(w) - len(v) + 1):
                if v and w[p : p + len(v)] == v:
                    hit.update(range(p, p + len(v)))
                    found.add(i)
        assert (r.doc_id, r.n_words, r.n_hit, r.n_items) == (r.doc_id, len(w), len(hit), len(found))
    assert next(r.n_hit for r in got if r.doc_id == 0) == 1


def test_html_text():
    page = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><div id="nav" class="site-nav"><a href=x>Menu</a></div><header>Top</header>
    <div class="cookie-notice">We use cookies, lots, really.</div><article><h1>Head &amp; line</h1><p>First, a   para&shy;graph<br>with &lt;marks&gt;.<p>Second <b>one</b>, yes.<ul><li>x<li>y</ul>
    <div class="comments"><p>Nice, nice, nice article, thanks!</p></div><aside>Side</aside><form>mail <input></form></article><div class="sidebar"><p>Other, other, stories, here.</p></div><footer>&copy; me</footer>"""
    assert htmltext.main_text(page) == "Head & line\nFirst, a para­graph with <marks>.\nSecond one, yes.\nx\ny"
    assert [htmltext.main_text(x) for x in (None, "", "  ", "plain & simple", "<p>a<p>b", "<div><p>x</p></div><div cla")] == ["", "", "", "plain & simple", "a\nb", "x"]
    deep = "<div>" * 5000 + "<p>deep down, there</p>"
    assert htmltext.main_text(deep) == "deep down, there"


_ARTICLE = "<h1>Head</h1><p>First, a paragraph of some length, with commas, and more.</p><p>Second one, a bit longer than it has to be, really.</p>"
_TEXT = "Head\nFirst, a paragraph of some length, with commas, and more.\nSecond one, a bit longer than it has to be, really."
_SIDE = "<div class='sidebar'><p>Other, other, stories, here, there.</p></div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='layout with-sidebar'><article>{_ARTICLE}</article>{_SIDE}</div>",
        f"<div class='no-sidebar'>{_ARTICLE}</div>",
        f"<div id='sidebar-left-page'><main>{_ARTICLE}</main></div>",
        f"<article class='post comments-open'>{_ARTICLE}</article>",
        f"<div class='widget'><article>{_ARTICLE}</article></div>",
        "<article><div class='article-header'><h1>Head</h1></div>" + _ARTICLE[13:] + "</article>",
        "<article><header class='header'><h1>Head</h1></header>" + _ARTICLE[13:] + "</article>",
        f"<article>{_ARTICLE}<section class='comments'>{'<article class=comment><p>Nice, nice, nice, so nice, thanks, all of you!</p></article>' * 30}</section></article>",
        f"<body class='has-sidebar'><div class='cookie-banner'>We, use, cookies.</div><div class='story'>{_ARTICLE}</div><div class='newsletter'><p>Sign up, now, for free, please.</p></div></body>",
        f"<div class='comments'>{_ARTICLE.replace('h1', 'h2')}</div>",
    ],
)
def test_html_names_are_weights(page):
    assert htmltext.main_text(page) == _TEXT


def test_html_of_several_articles_and_sections():
    second = "<p>Third, another article, of its own, as long as the first, or so.</p>"
    assert htmltext.main_text(f"<body><article>{_ARTICLE}</article><article>{second}</article><article><a href=x>Teaser</a></article></body>") == _TEXT + "\nThird, another article, of its own, as long as the first, or so."
    assert htmltext.main_text(f"<main><article>{_ARTICLE}</article><article>{second}</article></main>").count("\n") == 3
    assert htmltext.main_text(f"<div id=content><div>{_ARTICLE}</div><div><p>Short end.</p></div><div><h2>Bye</h2></div><div><a href=x>All the links</a></div></div>") == _TEXT + "\nShort end.\nBye"


def test_html_takes_time_by_length():
    import time

    def seconds(n):
        pages = ["<blockquote>x, " * n, "<div>" * n + "</span>" * n, "<header>" * n + "x", "<p>a<ul><li>" * n]
        began = time.process_time()
        for page in pages:
            htmltext.main_text(page)
        return time.process_time() - began

    seconds(500)
    assert seconds(8000) < 24 * seconds(1000)  # eight times the length


def test_html_query(spark):
    rows = spark.createDataFrame([(1, "u", "<p>one</p>"), (None, None, None), (1, "u", "<p>one</p>")], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in htmltext.query(rows.selectExpr("*", "1 AS text", "'x' AS n_chars")).collect()) == [("", 0), ("one", 3), ("one", 3)]
    assert htmltext.query(rows.where("false")).count() == 0


def _targets(sizes, weights):
    """Shares by weight, the excess shared again until none is above its cap."""
    total, caps, fixed = sum(sizes), [3 * s for s in sizes], {}
    while True:
        rest = total - sum(fixed.values())
        free = [i for i in range(len(sizes)) if i not in fixed]
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > caps[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: caps[i] for i in over}


def test_mixing(spark, docs, odd, empty):
    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), "en", rng.choice(["a", "b", "b", "b", "b", "c", "d", None]), 1) for i in range(600)] + [(900, "w " * 3, "en", "e", 1), (901, None, "en", "f", 0)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(table, bucket_rows=20).collect()
    sources = sorted({r.source for r in got}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in got if r.source == s) for s in sources]
    want = _targets(sizes, [i % 3 + 1 for i in range(len(sources))])
    for s, size, target in zip(sources, sizes, want):
        of = [r for r in got if r.source == s]
        assert all(r.source_size == size and abs(r.target - target) < 1e-6 and r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in of)
        assert abs(sum(r.taken for r in of) - target) <= max(r.size for r in of)
        assert max(r.uses for r in of) - min([r.uses for r in of if r.size] or [0]) <= 1
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(table, bucket_rows=7).collect()) == sorted((r.doc_id, r.taken) for r in got)
    out = mixing.sample(table)
    assert out.columns == table.columns and out.count() == sum(r.uses for r in got)
    assert mixing.query(empty).count() == 0 and mixing.query(docs).count() == docs.count()
    assert mixing.mix(odd).count() == 5


def test_warc(spark):
    big = "x" * 300_000
    rows = [(5, "http://a/", "y" * 100), (2, "http://b /\r\nX: y", "y" * 100), (7, None, "y" * 99), (8, "u", "y" * 99), (9, "u", None), (None, "u", "y" * 100), (11, "u", big), (12, "u", big), (12, "u", big), (13, "u", "é\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.query(pages).collect()), key=str)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if j is not None and (h or "").encode() == data]
        first = min(same) if len(data) >= 100 and same else i
        revisit = len(data) >= 100 and (i is None or first < i)
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/warc-test"
    index = warc.write(warc.records(pages), folder)
    chunks = warc.read(index, folder).where("page_id = 11").orderBy("chunk").collect()
    assert len(chunks) > 2 and sum(r.chunk_bytes for r in chunks) == 300_000 and max(r.chunk_bytes for r in chunks) <= warc.CHUNK and [r.last for r in chunks][-1]
    assert warc.query(pages.where("false")).count() == 0
    import glob
    import gzip

    whole = b"".join(gzip.open(x).read() for x in glob.glob(f"{folder.removeprefix('file://')}/*.warc.gz"))
    names = re.findall(rb"WARC-Record-ID: (\S+)", whole)
    assert len(names) == len(set(names)) == len(rows) and set(re.findall(rb"WARC-Refers-To: (\S+)", whole)) <= set(names)


@pytest.mark.parametrize("most", [100_000, 0])
def test_warc_verdicts_by_broadcast_and_by_shuffle(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_VERDICTS", most)
    rows = [(i % 7 if i % 5 else None, "u", ["a" * 150, "b" * 150, "c" * 20][i % 3], 1, "mine") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int, refers_to string")
    got = sorted(str((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in warc.query(pages).collect())
    want = []
    for i, _, html, *_ in rows:
        first = min(j for j, _, h, *_ in rows if h == html and j is not None)
        revisit = len(html) >= 100 and i != first
        want.append(str((i, len(html), "revisit" if revisit else "response", first if revisit else None)))
    assert got == sorted(want)


def test_warc_reads_other_writers():
    import io

    def record(kind, body, *fields):
        return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\n" + b"".join(x + b"\r\n" for x in fields) + b"Content-length:%d\r\n\r\n" % len(body) + body + b"\r\n\r\n"

    data = record(b"warcinfo", b"software: x\r\n") + record(b"response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello", b"Content-Type: application/http") + record(b"response", b"raw", b"Content-Type: text/dns") + record(b"revisit", b"HTTP/1.1 200 OK\r\n\r\n") + record(b"metadata", b"")
    got = list(warc._stream(warc._Inflated(io.BytesIO(data), 7), 7))
    assert [(r["record_type"], r["payload_bytes"], r["page_id"]) for r in got if r["last"]] == [("response", 5, None), ("response", 3, None), ("revisit", None, None)]
    assert [r["payload_digest"] for r in got if r["last"]][0] == hashlib.sha256(b"hello").hexdigest()
    with pytest.raises(ValueError):
        list(warc._stream(warc._Inflated(io.BytesIO(data[:60]), 7), 7))
    assert type(warc._store("file:///tmp")[0]).__name__ == "LocalFileSystem"


@pytest.mark.parametrize("top", [2, 40, 3000, 49_408, 65_536])
def test_range_coder(top):
    rng = np.random.default_rng(top)
    for n in (1, 2, 63, 64, 65, 5000):
        ids = np.minimum(rng.zipf(1.3, n), top - 1).astype(np.uint16)
        used, scaled, blocks = rangecoder.encode(ids, 64)
        assert max(size for size, _, _ in blocks) <= 64
        assert (rangecoder.decode(used, scaled, blocks) == ids).all()
    if top == 2:
        return
    for at in (0, 5):  # a block whose code is damaged, and one whose checksum is
        n, crc, code = blocks[at]
        for bad in ((n, crc, bytes([code[0] ^ 0x55]) + code[1:]), (n, crc, code[:4]), (n, crc ^ 1, code)):
            with pytest.raises(ValueError):
                rangecoder.decode(used, scaled, [*blocks[:at], bad, *blocks[at + 1 :]])
        assert (rangecoder.decode(used, scaled, blocks[at : at + 1]) == ids[sum(x[0] for x in blocks[:at]) :][:n]).all()
    with pytest.raises(ValueError):
        rangecoder.decode(used, scaled + np.uint32(1), blocks)


def test_range_coder_beats_order_0_and_carries():
    rng = np.random.default_rng(5)
    pairs = rng.integers(0, 500, (300, 3))
    ids = pairs[rng.zipf(1.2, 20_000) % 300].reshape(-1).astype(np.uint16)
    p = np.bincount(ids)[np.unique(ids)] / len(ids)
    used, scaled, blocks = rangecoder.encode(ids, 4096)
    assert 8 * sum(len(x) for _, _, x in blocks) < 0.8 * len(ids) * -(p * np.log2(p)).sum()
    top = np.full(40_000, 7, np.uint16)
    top[::97] = 9
    for x in (top, np.flip(np.sort(ids)), np.arange(60_000).astype(np.uint16)):
        assert (rangecoder.decode(*rangecoder.encode(x, 4096)) == x).all()


def test_tokenizers_are_told_by_their_definition(tmp_path):
    import json

    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    with open(public.path("word_bpe_49k.json"), encoding="utf-8") as source:
        plain = json.load(source)
    assert tokens.by_word(plain)
    for change in ({"added_tokens": [{"content": "a b"}]}, {"normalizer": {"type": "Strip"}}, {"pre_tokenizer": {"type": "ByteLevel"}}, {"pre_tokenizer": None}, {"truncation": {"max_length": 5}}):
        assert not tokens.by_word(plain | change)
    for pattern in ("a b|\\p{L}+", ".+", r"[^x]+", r"\S+\s?", r"[\s\S]"):
        assert not tokens.by_word(plain | {"pre_tokenizer": {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Removed", "invert": True}})
    texts = pa.array(["Don't  stop\tnow\u00a0x, Ünï<|endoftext|> ok", None, "", " a\x0bb\x1cc\n"])
    encoder = tokens.Encoder(public.path("word_bpe_49k.json"))
    got, want = encoder._by_word(pc.fill_null(texts, "")), encoder._whole([x or "" for x in texts.to_pylist()])
    assert all(np.array_equal(a, b) for a, b in zip(got, want)) and got[1].sum() == len(got[0])
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as source:
        assert not tokens.by_word(json.load(source))


def test_the_library_is_given_joined_and_new_words_only():
    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    class Counted:
        def __init__(self, inner):
            self.inner, self.texts = inner, 0

        def encode_batch_fast(self, texts, **how):
            self.texts += len(texts)
            return self.inner.encode_batch_fast(texts, **how)

    path = public.path("word_bpe_49k.json")
    encoder = tokens.Encoder(path)
    plain, encoder.tokenizer = encoder.tokenizer, Counted(encoder.tokenizer)
    want = lambda texts: [[*x.ids, 1] for x in plain.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]
    same = lambda got, texts: got[0].tolist() == sum(want(texts), []) and got[1].tolist() == [len(x) for x in want(texts)]
    words = [f"wörd{chr(97 + n % 26)}{n}'s<|endoftext|>Σ" for n in range(1000)]
    for texts in ([" ".join(words), None, ""], [*words[::-1], "\n".join(words)]):
        assert same(encoder.of(pa.array(texts)), texts)
    assert encoder.tokenizer.texts == 4  # 1000 words in texts of 256, once
    assert tokens._encoder(path, 0) is tokens._encoder(path, 0)
    # Words that hold the mark, and more words than may be remembered.
    few = tokens.Encoder(path, most_words=20)
    for a in range(0, 200, 7):
        texts = [" ".join(words[a : a + 9] + words[:3]), "x\x01 \x01 a\x01b" if a % 2 else "\x01y"[a % 3 :]]
        assert same(few.of(pa.array(texts)), texts)
    assert len(few.known) < 60


def test_token_ids(spark, docs, odd, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    extra = [(1000, "Spécial  <|endoftext|> it's x 12\tÀ́ 'll", "en", "s", 1), (1001, "ΣΑΣ don't   ", "en", "s", 1)]
    table = docs.where("length(text) < 100000 or text is null").union(spark.createDataFrame(extra, SCHEMA))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.query(table).collect()}
    start = 0
    for i, text in sorted((r.doc_id, r.text or "") for r in table.collect()):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokens.query(empty).count() == 0 and tokens.query(odd).count() == 5
