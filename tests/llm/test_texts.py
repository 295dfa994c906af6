import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from odd_rows import LONG, with_clashes
from fitframe.llm.bpe import encoded
from fitframe.llm.fingerprints import Fingerprinter, fingerprints
from fitframe.llm.hashing import mixed, shingle_set
from fitframe.llm.licenses import PART, TEMPLATES, known_grams, license_scan
from fitframe.llm.queries import bpe_digests


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bpe_equals_the_library(spark, small, odd_documents, tokenizer_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    unsplit = [(100, "ab" * 30_000), (101, "é" * 5000 + "zz" * 9000), (102, "<|endoftext|> a<s>b"), (103, "!?" * 20_000)]
    odd = odd_documents.select("doc_id", "text").union(spark.createDataFrame(unsplit, "doc_id long, text string"))
    documents = odd.union(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    # Parts far smaller than in production, so that texts and runs are cut.
    for parts in (1 << 20, 4096):
        rows = encoded(with_clashes(documents), tokenizer_path, part_chars=parts)
        digests = bpe_digests(rows).toPandas()
        found = sorted(zip(digests["doc_id"].fillna(-1), digests["n_tokens"], digests["ids_sha256"], digests["decoded_sha256"]))
        wanted = []
        for r in documents.collect():
            ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
            decoded = tokenizer.decode(ids, skip_special_tokens=False)
            packed = struct.pack(f"<{len(ids)}I", *ids)
            wanted.append((
                -1 if r["doc_id"] is None else r["doc_id"], len(ids),
                hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(),
            ))
        assert found == sorted(wanted)


def test_bpe_of_nothing(no_documents, tokenizer_path):
    assert encoded(no_documents, tokenizer_path).count() == 0


def test_bpe_loads_no_tokenizer_without_rows(spark):
    """Tasks that have no rows, as all of texts too long for one task mostly are, take no memory for a tokenizer."""
    rows = spark.range(0, 4, 1, 4).selectExpr("id AS doc_id", "concat('x', id) AS text").where("length(text) > 100")
    assert encoded(rows, "/no/such/tokenizer.json").count() == 0


def test_fingerprints(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    rows = fingerprints(documents).orderBy("doc_id").collect()
    texts = [r["text"] or "" for r in documents.orderBy("doc_id").collect()]
    assert len(rows) == len(texts)
    by_text = {}
    for i, (row, text) in enumerate(zip(rows, texts)):
        following = texts[(i + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    # Likeness against the exact Jaccard similarity of five-word shingles.
    gaps = []
    for i, (row, text) in enumerate(zip(rows, texts)):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + texts[(i + 1) % len(texts)][:cut]
        a, b = (set(zip(*(t.lower().split()[j:] for j in range(5)))) for t in (text, edited))
        if len(a) > 20 and len(b) > 20:
            gaps.append(abs(row["near_edited"] - len(a & b) / len(a | b)))
    assert sum(gaps) / len(gaps) < 0.05


def test_odd_fingerprints(odd_documents, no_documents):
    rows = fingerprints(with_clashes(odd_documents)).collect()
    assert len(rows) == odd_documents.count()
    prints = {}
    for r in rows:
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[1] == prints[2] and len(prints[1]) == 1
    assert prints[3] == prints[4] == prints[5]
    assert fingerprints(no_documents).count() == 0


def test_fingerprints_of_short_texts(spark):
    """Texts of a few words, none in common: nothing may look alike."""
    for words in (1, 3, 5, 6, 8, 12, 40):
        rows = [(i, " ".join(f"w{i}x{j}" for j in range(words))) for i in range(200)]
        found = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        nexts = [r["near_next"] for r in found]
        assert sum(nexts) / len(nexts) < 0.01
        assert max(nexts) < 0.1
        assert len({r["fingerprint"] for r in found}) == len(rows)


def test_fingerprint_codes_by_hand():
    """Every bin against its definition, hash by hash."""
    maker = Fingerprinter(5)
    bits = (1 << 64) - 1
    for words in (3, 7, 60, 2000):
        text = " ".join(f"w{j * j % 997}y{j}" for j in range(words))
        hashes = [int(h) for h in shingle_set(text, 5)]
        least = {}
        for h in hashes:
            bin = h >> 64 - 9
            least[bin] = min(h, least.get(bin, bits))
        for bin, code in enumerate(maker.codes(text)):
            if bin in least:
                assert code == least[bin] & 15
            else:
                source = min(least, key=lambda b: maker.turn[bin, b])
                own = np.array([(least[source] + int(maker.own[bin])) & bits], np.uint64)
                assert code == int(mixed(own)[0]) & 15


def test_licenses(spark, odd_documents, no_documents):
    texts = {
        1: "Released under the GNU General Public License, see the MIT license or CC-BY. MIT License",
        2: "gnu general public",
        3: None,
        4: "",
        5: "license",
        6: "apache apache license license",
        7: "xmit license mit licenses",
        8: "filler " * 60_000 + "mit license " + LONG,
        9: "GNU general public licence; gnu general public license",
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r for r in license_scan(with_clashes(rows)).collect()}
    assert len(found) == len(texts)

    def base(i):
        r = found[i]
        return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]

    assert base(1) == (16, 4, 3, 14, "cc-by,gpl,mit")
    assert base(2) == (3, 0, None, None, "")
    assert base(3) == base(4) == (0, 0, None, None, "")
    assert base(5) == (1, 0, None, None, "")
    assert base(6) == (4, 1, 1, 1, "apache")
    assert base(7) == (4, 0, None, None, "")
    assert base(8)[1:] == (1, 60_000, 60_000, "mit")
    assert base(9)[1:4] == (1, 4, 4)
    for r in found.values():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert license_scan(with_clashes(odd_documents)).count() == odd_documents.count()
    assert license_scan(no_documents).count() == 0


def test_license_texts(spark):
    """Templates beyond 64 places, whole, with words changed, and cut short."""
    for label, text in TEMPLATES:
        words = text.split()
        changed = [w if i % 40 != 20 else "replaced" for i, w in enumerate(words)]
        longer = words[: len(words) // 2] + ["two", "more"] + words[len(words) // 2 :]
        texts = [words, changed, longer, words[: len(words) // 3], words[::-1]]
        rows = [(i, "filler " * 50 + " ".join(t) + " filler") for i, t in enumerate(texts)]
        found = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert all(label in found[i]["labels"].split(",") for i in (0, 1, 2))
        assert found[0]["score"] == 1.0 and found[4]["score"] < 0.7
    # The last one is longer than a number has bits: a third of it is no license.
    assert len(known_grams()[-1]) > 2 * PART
    rest = " ".join(TEMPLATES[-1][1].split()[80:])
    cut = license_scan(spark.createDataFrame([(1, rest), (2, " ".join(rest.split()[:30]))], "doc_id long, text string"))
    scores = {r["doc_id"]: (r["labels"], round(r["score"], 1)) for r in cut.collect()}
    share = (len(rest.split()) - 3) / len(known_grams()[-1])
    assert scores[1][0] == "" and abs(scores[1][1] - share) < 0.1 and scores[2][1] < 0.3
