"""The ten operators against brute force on small fixtures with nulls, empties, ties, long texts and extra columns."""

import hashlib
import random
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import bottom_k, kneser_ney, language_id, line_dedup, media, merge_dropout, near_dup, packing, substring_dedup, textcore, url_filter
from factloom.llm.components import components

BPE, RANKS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, a long, signature string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefgéß", k=r.randint(1, 8))) for _ in range(400)]
    make = lambda n: " ".join(r.choices(vocabulary, k=n))
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "One  two"), (5, make(3000)), (6, "日本語 ▁ 😀\x00 x")]
    passage, base = make(60), make(200)
    for i in range(7, 60):
        if i % 4 == 0:
            out.append((i, make(40) + "\n" + passage + "\n" + make(30)))
        elif i % 4 == 1:
            w = base.split(" ")
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append((i, " ".join(w)))
        else:
            out.append((i, make(r.randint(1, 120)) + ("\n" + out[-1][1] if i % 7 == 0 and out[-1][1] else "")))
    out += [out[20], out[20], (70, out[5][1]), (71, "word " * 6000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, k, "x") for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(1, 1), (None, 2)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def naive_passages(rows, window):
    """(doc_id, words, words removed, digest of those kept) by looking at every window."""
    first = {}
    for i, t in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        w = words(t)
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    want = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return want


@pytest.mark.parametrize("window", [50, 7, 27])
def test_substring_dedup(docs, rows, nothing, window):
    want = naive_passages(rows, window)
    got = substring_dedup.report(docs, window)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(x[2] for x in want) > 500
    assert substring_dedup.report(nothing, window).count() == 0


def test_substring_dedup_levels():
    assert substring_dedup.lengths(50) == [13, 25, 50] and substring_dedup.lengths(7) == [7] and substring_dedup.lengths(100) == [13, 25, 50, 100]


def test_substring_dedup_edge_cases(spark, docs, rows, nothing):
    """Rows without an id, equal rows, two texts of one id, columns with the operator's own names; strip agrees with report."""
    a, b = " ".join(f"w{k}" for k in range(70)), " ".join(f"v{k}" for k in range(70))
    given = [(None, a, 1, 1), (None, None, 1, 1), (7, a, 2, 2), (7, a, 2, 2), (5, a, 3, 3), (5, b, 4, 4), (8, "x " + b, 5, 5), (9, "", 6, 6)]
    table = spark.createDataFrame(given, "doc_id long, text string, _row int, _kept_text int")
    assert sorted(map(str, map(tuple, substring_dedup.report(table).collect()))) == sorted(map(str, naive_passages([x[:2] for x in given], 50)))
    want = [(i, {7: "", 8: "x"}.get(i, t), *more) for i, t, *more in given]
    assert sorted(map(str, map(tuple, substring_dedup.strip(table).collect()))) == sorted(map(str, want))
    stripped = substring_dedup.strip(docs)
    assert stripped.columns == docs.columns and stripped.count() == len(rows)
    assert substring_dedup.strip(nothing).count() == 0


def test_near_dup(docs, rows, nothing):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = near_dup.report(docs)
    assert sorted(map(tuple, got.collect())) == sorted((i, len(sets[i]), find(i), find(i) == i) for i, _ in rows)
    assert len({find(i) for i in sets}) < len(sets) - 8
    assert near_dup.report(nothing).count() == 0


def test_near_dup_in_crowded_regions(docs, rows):
    """A small crowd limit takes all pairs through deeper levels; the result is the same."""
    a = near_dup.report(docs).select("doc_id", "component_id").distinct().collect()
    b = near_dup.report(docs, crowd=3).select("doc_id", "component_id").distinct().collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_near_dup_in_regions_of_many(spark):
    """Clusters of forty documents, many of whose pairs are near the limit: the components are those of all pairs."""
    r = random.Random(21)
    vocabulary = ["".join(r.choices(string.ascii_lowercase, k=6)) for _ in range(3000)]
    rows = []
    for _ in range(40):
        base = r.choices(vocabulary, k=120)
        for _ in range(40):
            w = list(base)
            for at in r.sample(range(120), r.randint(2, 4)):
                w[at] = r.choice(vocabulary)
            rows.append(" ".join(w))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (x.split(" ") for x in rows)]
    links = [(i, j) for c in range(0, len(rows), 40) for i in range(c, c + 40) for j in range(c, i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = roots(links)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["component_id"] for x in near_dup.report(docs).collect()}
    assert 500 < len(set(root.values())) + len(rows) - len(root) < len(rows) - 200
    assert got == {i: root.get(i, i) for i in range(len(rows))}


def test_near_dup_edge_cases(spark):
    """Rows without an id, equal rows, two texts of one id, columns with the operator's own names."""
    a, b = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [(None, a, 1), (None, None, 1), (7, a, 1), (7, a, 1), (5, a, 1), (5, b, 1), (9, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone_doc int")
    got = sorted(map(tuple, near_dup.report(docs).collect()), key=str)
    assert got == sorted([(None, 36, None, True), (None, 0, None, True), (7, 36, 5, False), (7, 36, 5, False), (5, 36, 5, True), (5, 36, 5, True), (9, 0, 9, True)], key=str)
    assert sorted(map(str, map(tuple, near_dup.one_of_each(docs).collect()))) == sorted(str(x) for x in rows if x[0] != 7)


def test_line_dedup(docs, rows, nothing, spark):
    got = {r["doc_id"]: r for r in line_dedup.report(docs).collect()}
    assert got[0]["n_lines"] == 0 and got[8]["n_removed"] == 0 and got[12]["n_removed"] == 1
    assert line_dedup.report(nothing).count() == 0
    lines = ["the quick brown fox jumps over the lazy dog near the old river bank", "the quick brown fox jumps over the lazy dog near the old river bend", "THE quick, brown fox jumps over the lazy dog near the old river bank!"]
    small = spark.createDataFrame([(1, lines[0] + "\nshort"), (2, lines[1] + "\nshort\n"), (3, lines[2] + "\nan entirely different line of the same kind stays here")], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in line_dedup.strip(small).collect()}
    assert kept[1] == lines[0] + "\nshort" and kept[3] == "an entirely different line of the same kind stays here"
    assert kept[2] == "short\n"
    assert line_dedup.strip(docs).columns == docs.columns


def test_line_dedup_against_brute_force(spark):
    """Short and long lines with edited words, scattered typos and none: as many lines go as all pairs' edit similarity says."""
    import duckdb

    r = random.Random(11)
    word = lambda: "".join(r.choices(string.ascii_lowercase, k=r.randint(4, 7)))
    lines = []
    for k in range(160):
        w = [word() for _ in range((4, 10, 14, 25)[k % 4])]
        lines.append(" ".join(w))
        if k % 3 == 0:  # one word
            at = r.randrange(len(w))
            lines.append(" ".join([*w[:at], "".join(r.choices(string.ascii_lowercase, k=len(w[at]))), *w[at + 1 :]]))
        elif k % 3 == 1:  # letters here and there
            c = list(lines[-1])
            for at in r.sample(range(len(c)), len(c) // 20):
                c[at] = "q" if c[at] != " " else " "
            lines.append("".join(c))
    con = duckdb.connect()
    con.execute("CREATE TABLE l AS SELECT unnest(?) AS i, unnest(?) AS t", [list(range(len(lines))), lines])
    links = con.sql("SELECT a.i, b.i FROM l a JOIN l b ON a.i < b.i AND levenshtein(a.t, b.t) <= floor(greatest(length(a.t), length(b.t)) * 0.1 + 1e-9)").fetchall()
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {i for i in range(len(lines)) if find(i) != i}
    assert len(want) > 80
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    assert {x["doc_id"] for x in line_dedup.report(docs).where("n_removed > 0").collect()} == want


def near_pairs(lines, similarity=0.9):
    """All pairs of lines that are that similar: edit distances of every pair whose lengths and letters allow it."""
    import duckdb

    lines = sorted(lines, key=len)
    size = np.array([len(x) for x in lines])
    # duckdb counts edits of bytes: one byte for each letter
    foreign = sorted({c for x in lines for c in x if c > "\x7f"})
    assert len(foreign) < 31
    single = str.maketrans({c: chr(1 + k + (k > 8)) for k, c in enumerate(foreign)})
    raw = [np.bincount(np.frombuffer(x.encode(), dtype=np.uint8), minlength=256)[[*range(97, 123), 48, 32]] for x in lines]
    letters, pairs = np.array(raw, dtype=np.int32), []
    for i in range(len(lines)):
        j = np.arange(i + 1, np.searchsorted(size, size[i] / similarity + 1e-9, side="right"))
        more = letters[j] - letters[i]
        least = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
        pairs += [(i, int(k)) for k in j[least <= np.floor(size[j] * (1 - similarity) + 1e-9)]]
    con = duckdb.connect()
    con.execute("CREATE TABLE l AS SELECT unnest(?) AS i, unnest(?) AS t", [list(range(len(lines))), [x.translate(single) for x in lines]])
    con.execute("CREATE TABLE p AS SELECT unnest(?) AS a, unnest(?) AS b", [[a for a, _ in pairs], [b for _, b in pairs]])
    near = "SELECT p.a, p.b FROM p JOIN l x ON x.i = p.a JOIN l y ON y.i = p.b WHERE levenshtein(x.t, y.t) <= floor(length(y.t) * ? + 1e-9)"
    return [(lines[a], lines[b]) for a, b in con.execute(near, [1 - similarity]).fetchall()]


def roots(pairs):
    """The root of each member of pairs' components."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_line_dedup_recall_on_the_documents(spark):
    """Of all pairs of similar lines of the table, as brute force finds them, at least nine in ten end in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toArrow()
    lines = set()
    for b in docs.to_batches():
        for _, found, chosen in line_dedup.normal_lines(iter([b]), line_dedup.MIN_CHARS):
            lines |= {found.normal_text(i) for i in chosen.tolist()}
    lines = {x for x in lines if len(x) < 600}
    links = near_pairs(lines)
    want = roots(links)
    table = spark.createDataFrame(list(enumerate(sorted(lines))), "doc_id long, text string").repartition(5)
    gone = {x["doc_id"] for x in line_dedup.report(table).where("n_removed > 0").collect()}
    kept = [x for k, x in enumerate(sorted(lines)) if k not in gone]
    groups = len(set(want.values()))
    assert len(lines) > 4000 and len(want) - groups > 100
    assert len(gone) >= 0.9 * (len(want) - groups) and len(kept) >= len(lines) - len(want) + groups


def test_line_dedup_pigeonhole():
    """Lines of nearly equal length whose 128-bit SimHashes differ in up to three bits are joined by candidates of three bits at most."""
    r = random.Random(3)
    word = lambda: "".join(r.choices(string.ascii_lowercase, k=6))
    base = [word() for _ in range(300)]
    rows = []
    for _ in range(400):
        w = list(base)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = word()
        rows.append(" ".join(w))
    (_, lines, chosen), *_ = line_dedup.normal_lines(iter([pa.RecordBatch.from_arrays([pa.array(rows)], names=["text"])]), 20)
    s1, s2 = line_dedup.simhashes(lines, chosen)
    d = line_dedup.digests(lines, chosen)[0]
    block, of = line_dedup.blocks(lines, chosen, s1, s2)
    a, b, bits = line_dedup.near(block, d[of], s1[of], s2[of], lines.characters(chosen)[of], 500, 0.9)
    joined = roots([(x, y) for x, y, n in zip(a.tolist(), b.tolist(), bits.tolist(), strict=True) if n <= 3])
    close = [(i, j) for i in range(len(rows)) for j in range(i) if 0 < np.bitwise_count(s1[i] ^ s1[j]) + np.bitwise_count(s2[i] ^ s2[j]) <= 3]
    assert len(close) > 20
    assert all(joined[int(d[i])] == joined[int(d[j])] for i, j in close)
    assert len(a) < 12 * len(rows)


def test_spanning_forest():
    """The edges kept are those of Kruskal's rule."""
    r = random.Random(9)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(900)] + [(300, 301)]
    up, want = list(range(400)), []

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, b) in enumerate(edges):
        if find(a) != find(b):
            up[find(a)] = find(b)
            want.append(k)
    x, y = np.array(edges).T
    assert line_dedup.spanning(x, y, 400).tolist() == want


def test_shared_runs_bound():
    """An edit takes at most three runs of three characters."""
    r = random.Random(12)
    for _ in range(200):
        a = "".join(r.choices("abcdé ", k=r.randint(1, 90)))
        b = list(a)
        edits = r.randint(0, 8)
        for _ in range(edits):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 1)] = r.choices("abcdé ", k=r.randint(0, 1))
        b = "".join(b)
        assert line_dedup.shared_runs([a, "x"], [b, "x"])[0] >= max(len(a), len(b)) - 2 - 3 * edits


def test_simhash_bits():
    """Bits by the majority of words, for lines of any number of words."""
    r = np.random.default_rng(2)
    count = np.array([1, 2, 254, 255, 256, 700, 3])
    h = r.integers(0, 1 << 63, int(count.sum()), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    at = np.cumsum(count) - count
    got = textcore.bit_majorities(h, at, count)
    for k, (i, n) in enumerate(zip(at, count, strict=True)):
        want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[i : i + n]) > n)
        assert int(got[k]) == want


def test_line_dedup_of_a_large_group(spark):
    """Thousands of variants of one line, and an unlike line within each of their blocks' crowd: one group, and the others stay."""
    r = random.Random(8)
    word = lambda: "".join(r.choices(string.ascii_lowercase, k=6))
    base = [word() for _ in range(30)]
    rows = []
    for _ in range(2500):
        w = list(base)
        w[r.randrange(30)] = word()
        rows.append(" ".join(w))
    others = [" ".join([*base[:4], *(word() for _ in range(26))]) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(rows + others)), "doc_id long, text string").repartition(4)
    gone = {x["doc_id"] for x in line_dedup.report(docs).where("n_removed > 0").collect()}
    assert gone == set(range(1, 2500))


def test_line_dedup_edge_cases(spark, nothing):
    """Rows without an id, equal rows, two texts of one id, columns with the operator's own names, an empty table."""
    line = "a line of more than twenty characters"
    rows = [(None, line, 1, 2, 3), (1, line, 1, 2, 3), (1, line, 1, 2, 3), (2, "x\n" + line.upper(), 4, 5, 6), (2, line + "\ny", 7, 8, 9), (3, None, 0, 0, 0), (4, "", 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th int, _row int, _gone_doc int")
    got = sorted(map(tuple, line_dedup.strip(docs).collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[2], (2, "x", 4, 5, 6), (2, "y", 7, 8, 9), rows[5], rows[6]], key=str)
    assert line_dedup.strip(docs).columns == docs.columns
    assert line_dedup.strip(nothing).count() == 0


def test_line_dedup_among_reordered_words(spark):
    """Lines of the same words share all blocks; two that are near meet whatever sorts between them."""
    r = random.Random(4)
    base = ["".join(r.choices(string.ascii_lowercase, k=5)) for _ in range(20)] + ["ab", "cd"]
    shuffled = [r.sample(base, len(base)) for _ in range(30)]
    swapped = [*base[:20], "cd", "ab"]
    rows = [(1, shuffled[0]), (5, base), *((6 + k, w) for k, w in enumerate(shuffled[1:])), (90, swapped)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert [x["doc_id"] for x in line_dedup.report(docs).where("n_removed > 0").collect()] == [90]


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in rows}
    got = packing.pack(docs, BPE, RANKS).collect()
    assert sum(r["length"] for r in got) == sum(len(ids[i]) for i, _ in rows)
    by_doc, by_sequence = {}, {}
    for r in got:
        raw = b"".join(x.to_bytes(4, "little") for x in ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        assert zlib.crc32(raw) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], set()).add((r["piece"], r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, x in ids.items():
        assert sorted(by_doc[i]) == [(k, a, n) for k, (a, n) in enumerate(packing.cut(len(x), 1024))]
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    plain = []  # best-fit decreasing, one piece at a time
    for n in sorted((r["length"] for r in got), reverse=True):
        fits = [k for k, used in enumerate(plain) if used + n <= 1024]
        if fits:
            plain[max(fits, key=lambda k: plain[k])] += n
        else:
            plain.append(n)
    assert len(by_sequence) <= len(plain) + 1
    assert packing.pack(nothing, BPE, RANKS).count() == 0


def test_best_two_fit():
    assert packing.best_two_fit({6: 1, 3: 1, 4: 2}, 10) == [([6, 4], 1), ([4, 3], 1)]
    assert packing.tightest_pair(__import__("numpy").array([0, 0, 1, 1, 0, 1]), 7, 4) == (2, 5)
    # greedy 7 + 2 leaves a gap of 2; two pieces fit more tightly in place of the 2
    assert packing.best_two_fit({7: 1, 3: 1}, 10) == [([7, 3], 1)]
    r = random.Random(3)
    hist = {r.randint(1, 99): r.randint(1, 50) for _ in range(60)}
    plan = packing.best_two_fit(hist, 100)
    used = {}
    for pattern, times in plan:
        assert sum(pattern) <= 100
        for x in pattern:
            used[x] = used.get(x, 0) + times
    assert used == hist


def test_units_encode_as_whole_texts():
    import pyarrow as pa

    from factloom.llm.textcore import Texts

    odd = ["", " ", "a\n\n b  c\n", "don't I'll  x's\t\ty", "é ñandú 12,345 $$$", "日本語 テキスト 😀", "a  b", "x <|endoftext|> y", "ab\r\ncd \n  ef"]
    e = packing.UnitEncoder(BPE, RANKS)
    for s in odd:
        if not packing._WIDE_SPACE.search(s.encode()):
            ids, _ = e.encode(Texts(pa.array([s])), 2)
            assert ids.tolist() == e.slow.encode(s, add_special_tokens=False).ids + [2]


def naive_dropout(sp, seed, rate, doc_id, text):
    """Ids by the method's own words: one agenda for each unit, a draw for each step of it."""
    full = (1 << 64) - 1

    def mix64(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    golden = 0x9E3779B97F4A7C15
    score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    of_byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
    out, places = [], []
    for place, unit in enumerate(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", text or "")):
        key = mix64(mix64((doc_id + seed * golden) & full) + place & full)
        if len(unit.encode()) > 20:
            key &= full - 1
        part = (["\u2581"] if place == 0 else []) + ["\ud800" if c == "\u2581" else "\u2581" if c == " " else c for c in unit]
        dead, step = set(), 0
        part = [(c, k) for k, c in enumerate(part)]
        while True:
            found = [(-score[a[0] + b[0]], k) for k, (a, b) in enumerate(zip(part, part[1:])) if a[0] + b[0] in score and (a, b) not in dead]
            if not found:
                break
            k = min(found)[1]
            word = mix64(key + (step >> 2) * golden & full)
            if word >> 16 * (step & 3) & 0xFFFF < round(rate * 65536):
                dead.add((part[k], part[k + 1]))
            else:
                part[k : k + 2] = [(part[k][0] + part[k + 1][0], part[k][1])]
            step += 1
        for p, _ in part:
            out += [sp.piece_to_id(p)] if p in score else [of_byte[x] for x in p.replace("\ud800", "\u2581").encode()]
        places.append(step)
    return [*out, 2], places


def test_merge_dropout_against_the_plain_agenda(spark, docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for rate, seed in ((0.1, 17), (0.5, 3)):
        got = {(r["doc_id"], tuple(r["ids"])) for r in merge_dropout.encode(docs, PIECES, rate=rate, seed=seed).collect()}
        want = {(i, tuple(naive_dropout(sp, seed, rate, i, t)[0])) for i, t in rows}
        assert got == want
    # one word many times: each occurrence has draws of its own
    many = spark.createDataFrame([(1, "international " * 400)], "doc_id long, text string")
    (ids,) = (r["ids"] for r in merge_dropout.encode(many, PIECES, rate=0.5).collect())
    pieces = "".join(" " if "\u2581" in sp.id_to_piece(i)[:1] else "" for i in ids)
    assert len(pieces) > 100
    ways, now = set(), []
    for i in ids[:-1]:
        if sp.id_to_piece(i).startswith("\u2581") and now:
            ways.add(tuple(now))
            now = []
        now.append(i)
    assert len(ways) > 30


def test_merge_dropout_of_a_megabyte_without_a_blank(spark):
    r = random.Random(6)
    text = "".join(r.choices("abcdeé", k=1 << 20))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (back,) = (x["text"] for x in merge_dropout.decode(merge_dropout.encode(docs, PIECES), PIECES).collect())
    assert back == text


def test_merge_dropout(docs, rows, nothing):
    import sentencepiece

    back = {r["doc_id"]: r["text"] for r in merge_dropout.decode(merge_dropout.encode(docs, PIECES, rate=0.3), PIECES).collect()}
    assert all(back[i] == (t or "") for i, t in rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = {r["doc_id"]: r["ids"] for r in merge_dropout.encode(docs, PIECES, rate=0.0).collect()}
    assert all(plain[i] == sp.encode(t or "") + [2] for i, t in rows if "▁" not in (t or ""))
    a, b, c = (sorted(map(tuple, merge_dropout.report(docs.repartition(n), PIECES, seed=s).collect())) for n, s in ((1, 1), (4, 1), (1, 2)))
    assert a == b != c
    assert merge_dropout.report(nothing, PIECES).count() == 0


def test_kneser_ney_sums_to_one(spark):
    """Probabilities over the vocabulary and the unknown word, after each context."""
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b a b"), (3, None), (4, "c c a")], "doc_id long, text string").withColumn("held_out", F.lit(False))
    for order in (2, 3):
        model = kneser_ney.train(docs, order)
        probes = [f"{x} {y}" for x in ("a", "b", "zz") for y in ("a", "b", "c", "unknown")]
        got = kneser_ney.score(model, spark.createDataFrame([(i, p, True) for i, p in enumerate(probes)], "doc_id long, text string, held_out boolean")).collect()
        alone = {r["doc_id"]: r["score"] for r in kneser_ney.score(model, spark.createDataFrame([(i, x, True) for i, x in enumerate(("a", "b", "zz"))], "doc_id long, text string, held_out boolean")).collect()}
        assert all(r["score"] < 0 and r["n_tokens"] == 3 for r in got) and all(v < 0 for v in alone.values())
        import numpy as np

        ids = np.array([kneser_ney.END, 0, 0, 0], dtype=np.uint64)
        import pyarrow as pa

        from factloom.llm.textcore import Texts

        total = 0.0
        for y in ("a", "b", "c", None, "unknown"):
            tokens, at = kneser_ney.token_ids(Texts(pa.array([f"a {y}" if y else "a"])))
            p, _ = kneser_ney.log_probabilities(model, tokens, at)
            total += 10 ** p[1]
        assert abs(total - 1) < 1e-9
        del ids


def test_kneser_ney_against_counts(docs, rows, nothing):
    held = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    model = kneser_ney.train(held.where("not held_out"))
    got = {r["doc_id"]: r for r in kneser_ney.score(model, held).collect()}
    train = [w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*words((t or "").translate(LOW)), ""]]
    assert all(r["train_tokens"] == len(train) for r in got.values())
    known = set(train)
    assert all(got[i]["n_known"] == sum(w in known for w in words((t or "").translate(LOW))) + 1 for i, t in rows)
    empty = nothing.withColumn("held_out", F.lit(False))
    assert kneser_ney.score(kneser_ney.train(empty), empty).count() == 0


def naive_kneser_ney(train, texts, order):
    """(score, base score) of each text by counting n-grams in dictionaries."""
    from collections import Counter, defaultdict
    from math import log10

    tokens = lambda t: [*words((t or "").translate(LOW)), "</s>"]
    padded = lambda t: ["<s>"] * (order - 1) + tokens(t)
    plain = Counter(w for t in train for w in tokens(t))
    counts = {order: Counter(tuple(p[i - order + 1 : i + 1]) for t in train for p in [padded(t)] for i in range(order - 1, len(p)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut, after = {}, {}
    for k, c in counts.items():
        n = [sum(x == j for x in c.values()) for j in (1, 2, 3, 4)]
        if min(n[:3]) == 0:
            cut[k] = [0.5, 1.0, 1.5]
        else:
            y = n[0] / (n[0] + 2 * n[1])
            cut[k] = [min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.05), j) for j in (1, 2, 3)]
        after[k] = defaultdict(list)
        for g, x in c.items():
            after[k][g[:-1]].append(x)

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(plain) + 1)
        follow = after[k].get(g[:-1])
        if not follow:
            return p(g[1:])
        c = counts[k].get(g, 0)
        spare = sum(cut[k][min(x, 3) - 1] for x in follow)
        return (max(c - (cut[k][min(c, 3) - 1] if c else 0), 0) + spare * p(g[1:])) / sum(follow)

    n, v = sum(plain.values()), len(plain)
    out = []
    for t in texts:
        x = padded(t)
        out.append((sum(log10(p(tuple(x[i - order + 1 : i + 1]))) for i in range(order - 1, len(x))), sum(log10((plain[w] + 1) / (n + v + 1)) for w in tokens(t))))
    return out


@pytest.mark.parametrize(("order", "heavy"), [(2, 0.001), (3, 0.001), (2, 0.00001), (3, 0.02)])
def test_kneser_ney_scores_against_dictionaries(docs, rows, order, heavy, monkeypatch):
    """Both score columns, whether contexts are heavy or not."""
    original = kneser_ney.heavy_contexts
    monkeypatch.setattr(kneser_ney, "heavy_contexts", lambda d, o: original(d, o, heavy))
    held = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    model = kneser_ney.train(held.where("not held_out"), order)
    got = {r["doc_id"]: (r["score"], r["base_score"]) for r in kneser_ney.score(model, held).collect()}
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    want = dict(zip([i for i, _ in rows], naive_kneser_ney(train, [t for _, t in rows], order), strict=True))
    assert sum(len(model.heavy[k]["context"]) for k in range(2, order + 1)) > 0
    for i, x in want.items():
        assert got[i] == pytest.approx(x, rel=1e-9)


def test_kneser_ney_perplexity_and_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "a b", False), (1, "a b", False)], "doc_id long, text string, held_out boolean")
    got = kneser_ney.perplexity(kneser_ney.score(kneser_ney.train(docs), docs)).collect()
    assert len(got) == 2 and all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / 3)) for r in got)


def test_media(docs, rows, nothing):
    got = media.report(docs).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        pay = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
    assert media.report(nothing).count() == 0


def test_media_shards(docs, tmp_path):
    rows = media.store(docs.coalesce(1), f"file://{tmp_path}/m").cache()
    places = media.catalog(rows).collect()
    shard = (tmp_path / "m" / places[0]["shard"]).read_bytes()
    assert sorted(media.members(shard)) == sorted(p["digest"] for p in places)  # each payload once
    assert rows.count() > len(places)


def test_url_filter(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("b.com", "", "block")]
    urls = [None, "", "nothing", "http://A.Example.ORG/es/x?y", "http://example.org/en/12", "http://example.org/en/2", "http://example.org", "http://x.com/fr/", "http://xcom/fr/", "http://b.com", "http://a.b.com/fr/1#z", "ftp://x.com/de/://", "http://x.com/fr//a"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")

    def want(u):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :])[0]
            host = host.translate(LOW)
        fits = [(h.count(".") + 1, len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    expected = [(i, *want(u)) for i, u in enumerate(urls)]
    assert sorted(map(tuple, url_filter.judge(pages, rules).collect())) == expected
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert sorted(map(tuple, url_filter.judge(pages, table, max_rules=2).collect())) == expected
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_bottom_k(docs, rows, nothing):
    got = sorted(bottom_k.report(docs).collect(), key=lambda r: r["doc_id"])
    ordered = sorted((i, t or "") for i, t in rows)

    def shingles(t):
        w = words(t.translate(LOW))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    def likeness(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    assert len(got) == len(rows)
    prints, edits = {}, {}
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        tail = len(t) // 4
        edited = t[: len(t) - tail] + following[:tail]
        match = [r for r in got if r["doc_id"] == i and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()]
        assert match and match[0]["n_chars"] == len(t)
        assert abs(match[0]["near_edited"] - likeness(shingles(t), shingles(edited))) < 0.2
        assert abs(match[0]["near_next"] - likeness(shingles(t), shingles(following))) < 0.2
        assert edits.setdefault(edited, match[0]["edited_fingerprint"]) == match[0]["edited_fingerprint"]
        assert prints.setdefault(t, match[0]["fingerprint"]) == match[0]["fingerprint"]
    assert all(edits[t] == prints[t] for t in prints.keys() & edits.keys())
    assert bottom_k.report(nothing).count() == 0


def test_bottom_k_containment(spark):
    a, b = " ".join(map(str, range(400))), " ".join(map(str, range(2000)))
    df = bottom_k.with_sketch(bottom_k.with_sketch(spark.createDataFrame([(a, b)], "a string, b string"), "a", "sa"), "b", "sb")
    inside, around, same = df.select(bottom_k.containment(F.col("sa"), F.col("sb")), bottom_k.containment(F.col("sb"), F.col("sa")), bottom_k.containment(F.col("sa"), F.col("sa"))).first()
    assert inside > 0.75 and 0.1 < around < 0.3 and same == 1.0


def test_bottom_k_merges(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(0, 700)))), (1, " ".join(map(str, range(500, 1200))))], "g long, text string")
    parts = bottom_k.with_sketch(df, "text", "s")
    merged = bottom_k.merge_all(parts, ["g"], "s").first()["s"]
    a, b = [r["s"] for r in parts.collect()]
    assert merged == sorted(set(a) | set(b))[: bottom_k.K]
    n = spark.createDataFrame([(merged,)], "s array<bigint>").select(bottom_k.distinct_count(F.col("s"))).first()[0]
    assert 900 < n < 1500


def test_language_id(spark, nothing):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()]
    docs = spark.createDataFrame(rows + [(5000, None, "en"), (5001, "12 !!", None), (5002, "", "fr")], "doc_id long, text string, lang string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    machines = language_id.train(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    got = {r["doc_id"]: r for r in language_id.predict(docs, machines).collect()}
    assert [got[i]["lang_pred"] for i in (5000, 5001, 5002)] == ["und"] * 3
    test = [(r["lang"], got[r["doc_id"]]) for r in rows if held(r["doc_id"])]
    assert sum(a == b["lang_pred"] for a, b in test) >= 0.98 * len(test)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.predict(nothing, language_id.train(nothing)).count() == 0
