import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from odd_rows import with_clashes
from fitframe.llm import line_dedup
from fitframe.llm.common import components
from fitframe.llm.line_dedup import deduplicated, removed_lines, with_removed, without_repeated_lines
from fitframe.llm.hashing import shingle_set
from fitframe.llm.ngram_join import (
    bitmap, bitmap_size, corpus_sketch, differing_bits, near_duplicates, one_of_each, place_in_sketch, role_sets,
)
from fitframe.llm.neighbours import nearest
from fitframe.plans.scratch import Scratch


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1)))


def brute_components(rows, k, percent):
    sets = [shingles(text, k) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if not a or 100 * min(len(a), len(sets[j])) < percent * max(len(a), len(sets[j])):
                continue
            both = len(a & sets[j])
            if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


def test_ngram_join_by_brute_force(spark, small, odd_documents):
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    documents = documents.union(odd_documents.where("coalesce(doc_id, 0) <> 1").withColumn("doc_id", F.col("doc_id") + 10**6).select("doc_id", "text"))
    rows = [tuple(r) for r in documents.collect()]
    found = [tuple(r) for r in near_duplicates(with_clashes(documents)).collect()]
    assert in_order(found) == in_order(brute_components(rows, 4, 85))


@pytest.mark.parametrize("seed", range(3))
def test_edited_long_texts(spark, seed):
    """Groups of copies with growing numbers of changed words, up to and over the limit."""
    random = np.random.default_rng(seed)
    rows = []
    for group in range(6):
        words = [f"w{x}" for x in random.integers(0, 10**6, size=int(random.integers(30, 6000)))]
        for copy in range(12):
            edited = list(words)
            for at in random.integers(0, len(words), size=int(len(words) * 0.004 * copy)):
                edited[at] = f"e{random.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(edited)))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in near_duplicates(documents).collect()]
    assert in_order(found) == in_order(brute_components(rows, 4, 85))


def test_differing_bits_never_exceed_the_difference():
    random = np.random.default_rng(0)
    for n, m in ((100, 120), (1500, 2100), (9000, 8000), (70_000, 60_000)):
        common = random.integers(0, 1 << 63, size=min(n, m) // 2, dtype=np.uint64)
        a, b = (np.concatenate([common, random.integers(0, 1 << 63, size=s - len(common), dtype=np.uint64)]) for s in (n, m))
        x, y = (bitmap(t, bitmap_size(len(t))).tobytes() for t in (a, b))
        differ = n + m - 2 * len(common)
        assert differ * 0.4 < differing_bits(x, y) <= differ
        assert differing_bits(x, x) == 0


def test_one_of_each(spark, small, odd_documents, no_documents):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    kept = one_of_each(documents)
    assert kept.columns == documents.columns
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    wanted = [d for d, n, c in brute_components(rows, 5, 80) if d == c or n == 0]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(wanted)
    odd = with_clashes(odd_documents)
    ids = [r["doc_id"] for r in one_of_each(odd).collect()]
    assert sorted(ids, key=lambda i: -1 if i is None else i) == [None, 1, 3, 4, 5, 6, 7, 9]
    assert one_of_each(no_documents).count() == near_duplicates(no_documents).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (2000, 2000)]
    edges = spark.createDataFrame(chain, "a long, b long")
    found = {r["id"]: r["component"] for r in components(edges, Scratch(spark)).collect()}
    assert found == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_nearest_by_brute_force(spark):
    random = np.random.default_rng(5)
    vectors = random.normal(size=(700, 24)).astype(np.float32)
    vectors[100:140] = vectors[7]  # ties
    vectors[200] *= 1000
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    bad = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23]
    rows += [(1000 + 20 * i, v) for i, v in enumerate(bad)] + [(None, [1.0] * 24), (2000, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [tuple(r) for r in nearest(with_clashes(table)).orderBy("query_id", "rank").collect()]
    wide = vectors.astype(np.float64)
    wanted = []
    for q in range(0, 700, 20):
        scores = wide @ wide[q]
        order = [i for i in np.lexsort((np.arange(700), -np.round(scores, 9))) if i != q][:20]
        wanted += [(q, rank, int(i)) for rank, i in enumerate(order, 1)]
    assert [r[:3] for r in found] == wanted
    for q, _, i, score in found:
        assert score == pytest.approx(float(wide[q] @ wide[i]), rel=1e-12, abs=1e-12)
    assert nearest(table.where("vec_id < 5")).count() == 4
    assert nearest(table.where("vec_id < 0")).count() == 0


LINES = [
    "The committee will publish its annual report on river quality next week.",
    "The committee will publish its annual report on river quality next week!",
    "A completely different sentence about baking bread in a stone oven.",
    "short",
]


def test_line_dedup(spark, odd_documents, no_documents):
    rows = [
        (2, f"{LINES[1]}\n{LINES[2]}\nshort"),
        (1, f"{LINES[0]}\nshort\n{LINES[0]}"),
        (3, LINES[1]),
        (4, None),
        (5, ""),
        (6, "\n\n"),
        (None, LINES[2]),
    ]
    documents = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in deduplicated(documents).collect()}
    assert found == {
        1: (f"{LINES[0]}\nshort", 1),
        2: (f"{LINES[2]}\nshort", 1),
        3: ("", 1),
        4: (None, 0),
        5: ("", 0),
        6: ("\n\n", 0),
        None: ("", 1),
    }
    marked, removed = with_removed(documents, 20, 0.8)
    places = {r["doc_id"]: r[removed] for r in marked.collect()}
    assert places == {1: [2], 2: [0], 3: [0], 4: None, 5: None, 6: None, None: [0]}
    kept = without_repeated_lines(documents)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 4, 5, 6}
    assert without_repeated_lines(no_documents).count() == 0
    odd = without_repeated_lines(odd_documents)
    by_id = {r["doc_id"]: r for r in odd.collect()}
    assert odd.columns == odd_documents.columns and odd.where("doc_id = 1").count() == 1
    assert 2 not in by_id and by_id[3]["text"] is None


def char_shingles(line):
    return {line[i : i + 5] for i in range(max(len(line) - 4, 1))}


def test_edited_lines_are_found(spark):
    """Pairs of edited lines alone: at least 97 of 100 with a similarity of 0.8 or more are candidates that link."""
    random = np.random.default_rng(11)
    words = ["".join(random.choice(list("abcdefghijklmnop"), int(n))) for n in random.integers(2, 10, 3000)]
    rows, wanted = [], 0
    for pair in range(3000):
        line = [words[i] for i in random.integers(0, 3000, int(random.integers(6, 60)))]
        edited = list(line)
        for at in random.integers(0, len(line), max(1, len(line) // 25)):
            edited[at] = words[random.integers(0, 3000)]
        a, b = " ".join(line), " ".join(edited)
        x, y = char_shingles(a), char_shingles(b)
        both = len(x & y)
        if a != b and both >= 0.8 * (len(x) + len(y) - both):
            rows += [(2 * pair, a), (2 * pair + 1, b)]
            wanted += 1
    assert wanted > 1000
    found = deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0")
    gone = [r["doc_id"] for r in found.collect()]
    assert all(d % 2 for d in gone) and len(gone) >= 0.97 * wanted


def test_tables_on_the_way_go(spark, monkeypatch):
    """Candidates and lists are deleted as soon as nothing reads them, in both rounds."""
    left, every = set(), []
    save, discard = Scratch._save, Scratch.discard

    def saved(self, writer, name):
        table = save(self, writer, name)
        left.add(table.name)
        every.append(name)
        return table

    def discarded(self, table):
        left.remove(table.name)
        discard(self, table)

    monkeypatch.setattr(Scratch, "_save", saved)
    monkeypatch.setattr(Scratch, "discard", discarded)
    words = [f"word{i}" for i in range(40)]
    # Neighbours in this chain are alike, its ends are not: the second round has pairs of its own.
    rows = [(i, " ".join(f"new{i}x{j}" if j < i else w for j, w in enumerate(words))) for i in range(12)]
    rows += [(i, f"{i} alone on this line are {i * i} words") for i in range(20, 30)]
    numbered = spark.createDataFrame(rows, "row long, text string").selectExpr("row", "row AS `order`", "text")
    removed_lines(numbered, Scratch(spark), 20, 0.8).collect()
    assert every.count("pairs") == every.count("close") == 2
    assert not [name for name in left if name.endswith(("_lists", "_places", "_mixed", "_pairs", "_close", "_sets"))]


def lines_with_edits(rng, n=24, length=60):
    """Lines of which many are near 0.8 alike, some above and some below, and a very long pair."""
    base = ["".join(rng.choice(list("abcdefgh "), 6)) for _ in range(length)]
    lines = []
    for i in range(n):
        words = list(base)
        for at in rng.choice(length, 1 + i % 8, replace=False):
            words[at] = "".join(rng.choice(list("uvwxyz"), 6))
        lines.append(" ".join(words))
    long = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(1500))
    return [*lines, long, long[:-400] + "another end"]


def test_sketches_leave_out_pairs_but_no_link(spark, monkeypatch):
    lines = lines_with_edits(np.random.default_rng(3))
    numbered = spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "row long, order long, text string")
    classes = numbered.select(F.col("row").alias("id"), "row", F.lit(0).alias("at"))
    pairs = spark.createDataFrame([(i, j) for j in range(len(lines)) for i in range(j)], "hub long, member long")
    whole = {i: {x[k : k + line_dedup.NARROW] for k in range(len(x) - line_dedup.NARROW + 1)} for i, x in enumerate(lines)}
    expected = {(i, j) for j in whole for i in range(j) if len(whole[i] & whole[j]) >= 0.8 * len(whole[i] | whole[j])}
    assert 10 < len(expected) < 200
    checked = []
    exact = line_dedup.not_far_apart

    def counted(*args):
        near = exact(*args)
        checked.append(near.count())
        return near

    monkeypatch.setattr(line_dedup, "not_far_apart", counted)
    links = line_dedup.alike_lines(pairs, numbered, classes, Scratch(spark), 0.8)
    assert {tuple(r) for r in links.collect()} == expected
    assert len(checked) == 1 and len(expected) <= checked[0] < 0.7 * pairs.count()
    few = pairs.limit(10)
    line_dedup.alike_lines(few, numbered, classes, Scratch(spark), 0.8).collect()
    assert len(checked) == 1


def test_sets_hold_every_run_of_characters(spark):
    """Also beyond 16 bits, where a character is not two."""
    lines = ["", "abc", "abcde", "aaaaaaaaaa", "\U0001f600 na\u00efve \U0001f601\U0001f600", "\U0001f600" * 8 + "end", "a\tb  c " * 9]
    found = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    found = found.select("id", F.size(line_dedup.narrow_hashes(F.col("line"))).alias("n")).collect()
    assert {r["id"]: r["n"] for r in found} == {i: len(char_shingles(x)) for i, x in enumerate(lines)}


def test_pairs_link_alike_with_and_without_sketches(spark):
    """Few pairs a line form sets where they meet, others once a line: the same pairs link."""
    lines = lines_with_edits(np.random.default_rng(8))
    classes = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id long, line string")
    sets = [char_shingles(x) for x in lines]
    every = [(i, j) for j in range(len(lines)) for i in range(j)]
    alike = {(i, j) for i, j in every if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    for pairs in (every, [(i, j) for i, j in every if j - i == 1]):
        table = spark.createDataFrame(pairs, "hub long, member long")
        links = line_dedup.alike_lines(table, None, classes, Scratch(spark), 0.8).collect()
        assert {tuple(r) for r in links} == alike & set(pairs) and links


def test_lines_leave_their_texts_once(spark, monkeypatch):
    """Both rounds look up the lines that meet others; texts are not read again for each."""
    cut, calls = line_dedup.cut_lines, []

    def counted(wanted, numbered):
        calls.append(wanted.count())
        return cut(wanted, numbered)

    monkeypatch.setattr(line_dedup, "cut_lines", counted)
    words = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(f"new{i}x{j}" if j < i else w for j, w in enumerate(words))) for i in range(12)]
    rows += [(i, f"{i} alone on this line are {i * i} words") for i in range(20, 30)]
    found = deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0")
    assert found.count() > 0
    assert len(calls) == 1 and 1 < calls[0] < len(rows)


def test_crowded_lists_make_few_pairs(spark, monkeypatch):
    """Lines with a passage in common, and near copies of a line: pairs grow with the lines, and no link is lost."""
    rng = np.random.default_rng(5)
    some = lambda n: ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(n)]
    passage, base = some(14), some(40)
    lines = [" ".join([*passage, *some(8)]) for _ in range(120)]
    for _ in range(120):
        words = list(base)
        for at in rng.choice(40, int(rng.integers(1, 6)), replace=False):
            words[at] = some(1)[0]
        lines.append(" ".join(words))
    sets, root = [char_shingles(line) for line in lines], list(range(len(lines)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                least, most = sorted((root[i], root[j]))
                root = [least if r == most else r for r in root]
    wanted = {i for i, r in enumerate(root) if r != i}
    assert len(wanted) > 50
    checked = []
    exact = line_dedup.may_be_alike

    def counted(pairs, classes):
        checked.append(pairs.count())
        return exact(pairs, classes)

    monkeypatch.setattr(line_dedup, "may_be_alike", counted)
    found = deduplicated(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert {r["doc_id"] for r in found.where("n_removed > 0").collect()} == wanted
    assert sum(checked) < 12 * len(lines), checked


def test_columns_of_any_name_pass(spark):
    names = ["row", "_row", "ROWS", "removed", "order", "at", "_line_row", "id", "h"]
    rows = [(i, f"{LINES[0]} {i // 2}", *(f"{n}{i}" for n in names)) for i in range(6)]
    documents = spark.createDataFrame(rows, ["doc_id", "text", *names])
    for kept in (without_repeated_lines(documents), one_of_each(documents)):
        assert kept.columns == documents.columns
        assert {r["doc_id"]: tuple(r)[2:] for r in kept.collect()}.items() <= {r[0]: r[2:] for r in rows}.items()
        assert kept.count() >= 1


def test_similar_lines_are_found(spark, small):
    """Against all pairs: what goes is like an earlier line; few alike lines stay apart."""
    documents = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 150").select("doc_id", "text")
    marked, removed = with_removed(documents, 20, 0.8)
    removed = {r["doc_id"]: set(r[removed] or []) for r in marked.collect()}
    lines = []
    for r in documents.orderBy("doc_id").collect():
        lines += [(r["doc_id"], at, line) for at, line in enumerate((r["text"] or "").split("\n")) if len(line) >= 20]
    sets = [char_shingles(line) for _, _, line in lines]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                both = len(a & b)
                if both >= 0.8 * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    wanted = {lines[i][:2] for i in range(len(lines)) if find(i) != i}
    found = {(d, at) for d, places in removed.items() for at in places}
    assert found <= wanted and len(found) >= 0.97 * len(wanted)


def test_copies_give_their_set_once():
    """200 copies of a hub and 100 edited texts: 101 sets travel, one for each role."""
    roles = [(1, "a b c d e f", 7, 0, None)] * 200 + [(10 + i, f"a b c d e {i}", 7, 0, 10 + i) for i in range(100)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c) for c in zip(*roles)], names=["text_key", "text", "hub", "salt", "member"]
    )
    assert len(list(role_sets(iter([batch, batch]), 4))) == 101


def test_sketch_counts_texts(spark):
    rows = [(f"common words in every text {i} and {i * 7} more {i * 13} of them",) for i in range(3000)]
    sketch = corpus_sketch(spark.createDataFrame(rows, "text string").repartition(7), 4)
    met = sketch[place_in_sketch(shingle_set(rows[0][0], 4))]
    # A counter of a task is a byte.
    assert min(sorted(met)[-2:]) >= 7 * 250 and (sketch > 8).sum() < 40
