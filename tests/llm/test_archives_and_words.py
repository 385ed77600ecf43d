"""Merkle manifest, spelling variants and WARC archives against brute force, with nulls, ties, repeats and empty tables."""

import gzip
import hashlib
import json
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import merkle, spelling, warc
from barloom.llm.common import Scratch
from barloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree long, leaf string, pos int, node string, height string"


def tamper():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, more=0):
    n = row["n_chars"] if row["n_chars"] is None else row["n_chars"] + more
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], n, row["text"])))


def halve(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def proofs(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r["lang"]].append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)), r))
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    own = {}
    for g in order:
        trees[g].sort(key=lambda t: t[0])
        own[g] = halve([t[0][2] for t in trees[g]])
    top = halve([own[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for p, ((_, _, true), r) in enumerate(trees[g]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now, siblings = leaf(r, int(hit)), []
            for tree, at in ((own[g], p), (top, k)):
                for level in tree[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    siblings.append(other)
                    now, at = sha(other + now if at & 1 else now + other), at >> 1
            out.append((r["doc_id"], true, own[g][-1][0], top[-1][0], sha("".join(siblings)), now, now == top[-1][0]))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    out = [(i if i % 13 else None, "t" * i if i % 5 else None, [None, "en", "de", "é", "e"][i % 5] if i % 3 else "en", f"s{i}", i if i % 4 else None)
           for i in range(90)]
    out += [(7, "", "lone", None, 0), (2, "big" * 700_000, "en", "s", 2_100_000), (4, "x", "en", "s", 2**63 - 1)] + [(5, "same", "en", "s", 4)] * 6
    return out


@pytest.mark.parametrize("page", [2, 10])
def test_merkle_is_the_plain_tree(spark, rows, page):
    docs = spark.createDataFrame([(*r, 1, "l", 2, "n", "h") for r in rows], DOCS).repartition(4)
    got = merkle.manifest(docs, tamper(), page)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == proofs([r.asDict() for r in docs.collect()])


def test_merkle_of_few_documents(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS), tamper()).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, "a", None, "s", 1, 1, "l", 2, "n", "h")], DOCS), tamper()).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("") and one.verified


def test_merkle_query_finds_what_was_tampered(spark):
    got = QUERIES["op11_merkle_manifest"](spark, FOLDER).collect()
    docs = [r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in got), key=repr) == proofs(docs)
    assert {r.doc_id for r in got if not r.verified} == {d["doc_id"] for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(docs):
    words = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                words[run] += 1
    words = {w: n for w, n in words.items() if n >= 3}
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_size[len(w) + k] if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdeéßÿ×Ün"), rng.integers(4, 9))) for _ in range(40)]
    words = [w for b in base for w in (b, b, b, b[:-1], b + "a", "x" + b, b[::-1])]
    out = [" ".join(rng.choice(words, 60)) for _ in range(60)]
    return list(enumerate(out)) + [(None, "hello hello hello help"), (61, None), (62, ""), (5, out[5]), (63, "long" * 30_000 + " " + "9 word" * 10_000),
                                   (65, "chain " * 4 + "chains " * 9 + "chainsa " * 20), (64, "Straße,STRASSE straße Ärger ÄRGER ärger ärger aaaaa aaaaa aaaaa aaaab aaaab aaaab")]


@pytest.mark.parametrize("trie_words", [20_000, 3])
def test_variants_are_those_of_all_pairs(spark, texts, trie_words):
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in texts], "doc_id long, text string, word string, prefix string, n int").repartition(3)
    want = plain_variants(texts)
    assert result(spelling.variants(docs, trie_words=trie_words)) == want
    assert any(f for f, *_ in want.values()) and any(v[0] and v[1] != v[0] for v in want.values())
    assert spelling.variants(docs.limit(0)).count() == 0 and spelling.variants(docs.where("text IS NULL OR text = ''")).count() == 0


def test_variants_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert result(QUERIES["op12_spelling_variants"](spark, FOLDER)) == plain_variants([(r.doc_id, r.text) for r in docs])


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "alpha beta;gamma deltadeltadelta, é epsilon" * 3
    assert Counter(w for p in spelling._pieces(text) for w in spelling.RUN.findall(p)) == Counter(spelling.RUN.findall(text))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abéx", min_size=1, max_size=6), min_size=1, max_size=40, unique=True),
       st.lists(st.text(alphabet="abéx", min_size=1, max_size=6), min_size=1, max_size=40, unique=True), st.booleans())
def test_trie_search_finds_all_near_words(words, queries, large):
    w, q = spelling.near_pairs([x.encode("latin-1") for x in words], [x.encode("latin-1") for x in queries])
    assert set(zip(w.tolist(), q.tolist())) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(queries) if one_edit(a, b)}


def test_large_leaves_are_matched_by_halves():
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.permutation(list("aeinrstold"))) for _ in range(700)})  # one vector
    w, q = spelling.near_pairs([x.encode() for x in words], [x[:4] + x[5:] for x in [v.encode() for v in words]])
    assert {(i, j) for i, j in zip(w.tolist(), q.tolist())} == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b[:4] + b[5:])}


PAGES = "page_id long, url string, html string, digest string, shard int, payload string, same string"


@pytest.fixture(scope="module")
def pages(spark):
    long, other = "é" * 700, "<p>" + "b" * 2000
    rows = [(i, f"http://h/{i} ü\r\nX-Bad: 1", f"<html>{i}" + "z" * (i * 37)) for i in range(60)]
    rows += [(100 + i, f"http://c/{i}", long) for i in range(30)] + [(200, None, other), (201, "u", other), (201, "u", other), (None, "n", other)]
    rows += [(300 + i, "s", "short") for i in range(4)] + [(400, "e", ""), (401, "e", None), (None, None, None), (None, "q", "q" * 1500), (None, "r", "q" * 1500)]
    rows += [(2**60 + i, "big", f"{i}" * 900) for i in range(3)] + [(500, "long", "y" * 3_000_000)]
    return spark.createDataFrame([(*r, "d", 1, "p", "s") for r in rows], PAGES).repartition(5)


def plain_pages(rows):
    heads = {}
    for r in rows:
        data = (r.html or "").encode()
        if len(data) >= 1000 and r.page_id is not None:
            heads[data] = max(heads.get(data, r.page_id), r.page_id)
    out = []
    for r in rows:
        data = (r.html or "").encode()
        head = heads.get(data, r.page_id)
        out.append((r.page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if head == r.page_id else "revisit", None if head == r.page_id else head))
    return sorted(out, key=repr)


def files_of(folder):
    path = folder.removeprefix("file:")
    return {n: open(f"{path}/{n}", "rb").read() for n in sorted(os.listdir(path)) if not n.startswith("_")}


DIGEST = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_archive_reads_back(spark, pages):
    scratch = Scratch(spark)
    one, two = f"{scratch.folder}/one", f"{scratch.folder}/two"
    warc.archive(pages, one, "2024-01-01T00:00:00Z", shard_bytes=20_000, roll_bytes=600)
    got = warc.read(spark, one).cache()
    assert sorted((tuple(r) for r in got.select(*DIGEST).collect()), key=repr) == plain_pages(pages.collect())
    first = files_of(one)
    assert len(first) > 8 and any(n.endswith("-00001.warc.gz") for n in first) and "_temporary" not in os.listdir(one.removeprefix("file:"))
    # the same rows in another order and number of partitions: the same bytes
    warc.archive(pages.orderBy(F.desc("html")).repartition(2), two, "2024-01-01T00:00:00Z", shard_bytes=20_000, roll_bytes=600)
    assert files_of(two) == first
    # revisits name a response that holds their payload; ids are unique; texts come back whole
    held = {r.record_id: r for r in got.where("record_type = 'response'").collect()}
    assert len(held) + got.where("record_type = 'revisit'").select("record_id").distinct().count() == got.count()
    for r in got.where("record_type = 'revisit'").collect():
        head = held[r.refers_id]
        assert (head.page_id, head.payload_digest, head.payload_bytes) == (r.refers_to, r.payload_digest, r.payload_bytes) and r.payload is None
    texts = {r.page_id: r.html or "" for r in pages.collect()}
    assert all(bytes(r.payload).decode() == texts[r.page_id] for r in held.values() if r.page_id is not None)
    # files are range-sorted, and each record is a gzip member of its own
    about = [json.loads(line) for line in first[warc.MANIFEST].splitlines()]
    assert sum(a["records"] for a in about) == pages.count()
    known = [a for a in about if a["first"] is not None and a["last"] is not None]
    assert all(a["first"] <= a["last"] for a in known) and all(x["last"] <= y["first"] for x, y in zip(known, known[1:]))
    assert [a["file"] for a in about] == sorted(a["file"] for a in about)
    data = first[about[-1]["file"]]
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(re.findall(b"\x1f\x8b\x08\x00\x00\x00\x00\x00", data)) == about[-1]["records"] + 1
    with pytest.raises(Exception, match="committed archive"):
        warc.archive(pages, one, "2024-01-01T00:00:00Z")


def test_readers_know_only_committed_and_sound_files(spark, pages):
    scratch = Scratch(spark)
    folder = f"{scratch.folder}/kept"
    warc.archive(pages.where("page_id < 20"), folder, "2024-01-01T00:00:00Z")
    path = folder.removeprefix("file:")
    name = next(n for n in os.listdir(path) if n.endswith(".gz"))
    with open(f"{path}/{name}.lost-task", "wb") as f:
        f.write(b"junk")
    assert warc.read(spark, folder).count() == 20
    data = open(f"{path}/{name}", "rb").read()
    with open(f"{path}/{name}", "wb") as f:
        f.write(data + warc._member(b""))
    with pytest.raises(Exception, match="not the file of the manifest"):
        warc.read(spark, folder).count()
    os.remove(f"{path}/{warc.MANIFEST}")
    with pytest.raises(Exception, match="manifest"):
        warc.read(spark, folder).count()


def test_archive_of_no_pages(spark, pages):
    scratch = Scratch(spark)
    warc.archive(pages.limit(0), f"{scratch.folder}/none", "2024-01-01T00:00:00Z")
    assert warc.read(spark, f"{scratch.folder}/none").count() == 0


def test_archive_query(spark):
    got = QUERIES["op13_warc_archive"](spark, FOLDER)
    assert got.columns == list(DIGEST)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_pages(spark.read.parquet(f"{FOLDER}/pages.parquet").collect())
