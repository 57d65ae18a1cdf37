"""WARC archives, spelling variants and prefix tries against brute force and on edge cases."""

import base64
import gzip
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from recolake.llm import prefix_trie, spelling, warc
from recolake.llm.common import scratch_path

from .conftest import rows_of

PAGES = "page_id long, url string, html string, page string, key string"


def archive(spark, rows, least_bytes=0, **files):
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES).repartition(3)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(warc.page_records(pages, least_bytes), f"{path}/monolithic", **files)
    return path, warc.normalise(spark, f"{path}/monolithic", path)


def brute_pages(rows, least_bytes=0):
    out, first = [], {}
    for i, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        raw = (html or "").encode()
        old = raw in first and len(raw) >= least_bytes
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if old else "response", first.get(raw) if old else None))
        first.setdefault(raw, i)
    return out


ROWS = [(5, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (9, None, None), (8, "http://c/\r\nX-Page-ID: 7", ""),
        (None, "http://d/", "other"), (None, "http://d/", "<p>same</p>"), (11, "http://é/", "é\r\n\r\nWARC/1.1\r\n\r\n\nü" * 3), (12, "u", "x\n" * 400_000),
        (13, "u", "\r\n"), (14, "u", "\n")] + [(100 + i, f"http://h/{i}", "hot") for i in range(60)]


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def test_archives_round_trip_and_edges(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK_BYTES", 500)
    for least in (0, 4, 1 << 30):
        path, index = archive(spark, ROWS, least, file_records=7)
        got = rows_of(warc.page_table(warc.read_records(index)))
        assert sorted(got, key=key) == sorted(brute_pages(ROWS, least), key=key)
    path, index = archive(spark, [])
    assert rows_of(warc.page_table(warc.read_records(index))) == []
    # equal rows beyond one block
    monkeypatch.setattr(warc, "COPIES", 4)
    many = [(7, "u", "t")] * 11 + [(6, "u", "t")] * 4
    assert sorted(rows_of(warc.page_table(warc.read_records(archive(spark, many)[1]))), key=key) == sorted(brute_pages(many), key=key)


def test_normalised_archive_is_plain_members_at_the_offsets(spark):
    path, index = archive(spark, ROWS)
    entries = sorted(rows_of(index))
    records = []
    for name in {e[0] for e in entries}:
        raw, own = open(name.removeprefix("file:"), "rb").read(), [e for e in entries if e[0] == name]
        # members cover the file without a gap, and each is a record by itself
        assert [e[1] for e in own] == [sum(x[2] for x in own[:i]) for i in range(len(own))] and sum(e[2] for e in own) == len(raw)
        members = [gzip.decompress(raw[e[1]:e[1] + e[2]]) for e in own]
        assert b"".join(members) == gzip.decompress(raw)
        records += members
    assert len(records) == len(ROWS) and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
    assert len({e[3] for e in entries}) == len(ROWS)


def test_record_stream_in_any_pieces():
    r = random.Random(3)
    bodies = [r.randbytes(r.randrange(0, 40)) for _ in range(30)] + [b"\r\n\r\n" * 5]
    records = [b"WARC/1.0\r\ncontent-LENGTH:%d\r\nA: b\r\n c\r\n\r\n%s" % (len(b), b) for b in bodies]
    stream = b"\r\n".join(x + warc.END for x in records)
    for size in (1, 3, 7, 50, len(stream)):
        s = warc.Records()
        assert [x for a in range(0, len(stream), size) for x in s.feed(stream[a:a + size])] == records
        s.close()
    s = warc.Records()
    assert list(s.feed(stream[:-10])) == records[:-1]
    with pytest.raises(ValueError, match="inside a record"):
        s.close()
    assert warc.headers(b"WARC/1.0\r\nA: b\r\n c")["a"] == "b c"


def test_changed_payload_is_an_error(spark):
    path, index = archive(spark, [(1, "u", "text")])
    (name, offset, length, *_), = rows_of(index)
    file = name.removeprefix("file:")
    record = gzip.decompress(open(file, "rb").read()).replace(b"text", b"tent")
    with open(file, "wb") as f:
        f.write(changed := gzip.compress(record, mtime=0))
    with pytest.raises(Exception, match="payload digest"):
        warc.read_records(index.withColumn("length", F.lit(len(changed)).cast("long"))).collect()


def brute_variants(n, ratio):
    def edits(w):
        return {w[:i] + w[i + 1:] for i in range(len(w))}
    near = defaultdict(set)
    slots = defaultdict(list)
    for w in n:
        for i in range(len(w)):
            slots[w[:i], w[i + 1:]].append(w)
        for v in edits(w) & n.keys():
            near[v].add(w)
            near[w].add(v)
    for group in slots.values():
        for w in group:
            near[w] |= {v for v in group if v != w}
    form = {}
    for w in n:
        best = min(((-n[v], v) for v in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], form[w] and n[form[w]], root))
    return sorted(out)


def some_words(seed, letters, count, sizes):
    r = random.Random(seed)
    return {"".join(r.choices(letters, k=r.choice(sizes))): r.choice([1, 2, 3, 10, 40, 150, 1000, 20_000]) for _ in range(count)}


@pytest.mark.parametrize(("cell", "sample"), [(50_000, 1000), (40, 200), (7, 30)])
def test_variants_against_brute_force(spark, cell, sample):
    n = some_words(1, "abcé", 500, (3, 4, 5, 6)) | some_words(2, "abcdefghijklmnopqrstuvwxyzàÿ", 200, (1, 2, 7, 8))
    long = "".join(random.Random(4).choices("abcdefgh", k=5000))
    n |= {long: 1, long[:2500] + long[2501:]: 30, long[:10] + "z" + long[11:]: 4000, long[::-1]: 5, "z" * 600: 1, "z" * 601: 11, "z" * 300 + "y" + "z" * 299: 500}
    rows = [(w, k, "x") for w, k in n.items()] + [(None, 5, "x"), ("abc", None, "x")]
    got = spelling.variants(spark.createDataFrame(rows, "word string, n long, form string").repartition(3), 10, cell, sample)
    assert sorted(rows_of(got.select("word", "n", "n_near", "form", "form_n", "root"))) == brute_variants(n, 10)


def test_variants_edges(spark):
    def run(rows, ratio=10):
        return sorted(rows_of(spelling.variants(spark.createDataFrame(rows, "word string, n long"), ratio).select("word", "form", "root", "n")))
    assert run([]) == []
    # repeated words add up; a tie of forms goes to the smaller word; forms are followed through several steps
    chain = [("a" * k + "b" * (20 - k), 3 ** k) for k in range(12)]
    got = {w: (form, root, n) for w, form, root, n in run(chain, 3)}
    assert all(got[w][1] == chain[-1][0] for w, _ in chain)
    assert run([("colour", 1), ("colour", 1), ("colxur", 20), ("colzur", 20)])[0] == ("colour", "colxur", "colxur", 2)
    with pytest.raises(Exception, match="something else"):
        run([("naïve", 1), ("na-ve", 2)])
    with pytest.raises(ValueError, match="commoner"):
        run([("a", 1)], 1)


def test_anagrams_in_one_leaf():
    r = random.Random(6)
    words = sorted({"".join(r.sample("aabbccdde", 9)) for _ in range(900)})
    others = sorted({w.replace("e", "f") for w in words[::3]})
    points, queries = spelling.letters(words, 9), spelling.letters(others, 9)
    got = {(others[q], words[p]) for a, b in spelling.near_pairs(points, queries) for q, p in zip(a, b, strict=True)}
    want = {(o, w) for o in others for w in words if sum(x != y for x, y in zip(o, w, strict=True)) == 1}
    assert got == want and len(want) >= len(others)


def test_slipped_runs(make):
    import re
    import zlib
    texts = [(1, "Colourful ÉTÉété-naïveté x1y colourfulĀcolourful " * 40), (2, None), (3, ""), (None, "Colourful wordings"), (4, "Á" * 30 + " ×÷×÷×÷×÷ 漢字colourful")]
    texts += [(i, "Some ordinary wording repeats between documents") for i in range(10, 80)]
    want = []
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                want.append(run)
    got = [r.word for r in spelling.slipped_runs(make(texts), 31, 7).collect()]
    assert sorted(got) == sorted(want)
    counts = dict(rows_of(spelling.word_counts(spelling.slipped_runs(make(texts), 31, 7), 2)))
    assert counts == {w: want.count(w) for w in set(want) if want.count(w) >= 2}


def brute_trie(convs):
    """convs: {conv_id: [(role, text)]}"""
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, own in members.items():
        below = [x for x in members if x[:len(node)] == node]
        ends = ",".join(str(c) for c in own if len(convs[c]) == len(node))
        out.append((own[0], len(node), members[node[:-1]][0] if node else None, len(own),
                    sum(len(x) == len(node) + 1 for x in below), sum(not any(y[:-1] == x for y in members if y) for x in below),
                    sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string, steps string, n string"


def trie_rows(spark, convs, range_turns, edit=lambda x: x):
    rows = [(c, k, r, t, "x", "y") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    own = prefix_trie.conversations(spark.createDataFrame(rows, TURNS).repartition(4))
    got = prefix_trie.trie(edit(own), range_turns)
    return sorted(rows_of(got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")), key=repr)


@pytest.mark.parametrize("range_turns", [100_000, 60, 9])
def test_trie_against_brute_force(spark, range_turns):
    r = random.Random(8)
    steps = [("u", ""), ("a", "é"), ("u", "abc"), ("", "abc")]
    convs = {c: [r.choice(steps) for _ in range(r.choice([1, 1, 2, 3, 5, 7]))] for c in range(-40, 110)}
    convs |= {c: steps * 3 for c in range(200, 230)}  # a common conversation over the borders of ranges
    convs |= {1000 + c: steps * 3 + [("u", f"{c % 3}")] * c for c in range(6)}
    assert trie_rows(spark, convs, range_turns) == brute_trie(convs)


def test_grafted_conversations(spark):
    import zlib
    r = random.Random(2)
    rows = [(c, k, r.choice(["u", None]), r.choice(["x", "yy", None])) for c in [*range(-7, 30), 101] if c % 7 for k in (None, *range(r.randrange(0, 12)))]
    rows += [(None, 1, "u", "x"), (None, None, None, None)]
    own = defaultdict(list)
    for c, k, role, text in rows:
        if c is not None:
            own[c].append((k is not None, k or 0, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        convs[c] = own.get(base, [])[:h] + turns[h:]
    table = prefix_trie.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    got = prefix_trie.trie(prefix_trie.grafted(table, F.col("conv_id") - F.col("conv_id") % 5, head, 8))
    want = brute_trie(convs)
    assert [] in convs.values() and sorted(rows_of(got), key=repr) == want


def test_trie_edges(spark):
    assert trie_rows(spark, {}, 10) == []
    text = "long " * 300_000
    convs = {1: [("u", text)], 2: [("u", text)], 3: [("u", text), ("a", "")]}
    assert trie_rows(spark, convs, 10) == brute_trie(convs)
    empty = hashlib.sha256(b"7").hexdigest()
    nothing = trie_rows(spark, {7: [("u", "x")]}, 10, lambda c: c.withColumn("steps", F.slice("steps", 1, 0)))
    assert nothing == [(7, 0, None, 1, 0, 1, 0, empty)]
