"""Operators 11 to 13 against brute force: nulls, empty and very long texts, ties, repeated rows, clashing columns, no rows."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import QUERIES, conversations, decontamination, oracles, spelling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, hit int, items string, c0 int, c_text string"


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def leaks(docs, items, window=10):
    """doc_id -> (n_words, hit positions, item ids), a list in the rows' order."""
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a : a + n])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        out.append((i, len(w), sorted(hit), sorted(found - {None})))
    return out


def leaky_tables():
    rng = random.Random(11)
    some = lambda n, of="ab cd Ef été 7x ß ÖL q".split(): " ".join(rng.choice(of) for _ in range(n))
    items = [(1, some(14)), (2, some(30)), (3, "Only three words"), (4, "été"), (5, None), (6, " .,! "), (7, some(12)), (7, some(12)), (None, some(13)), (8, "same ten words " * 3 + "end"), (9, "same ten words " * 3 + "end"), (10, some(260))]
    docs = [(0, None), (1, ""), (2, "--- !!"), (3, items[0][1]), (4, "x " + items[1][1].upper() + " y"), (5, items[1][1][4:-3]), (6, "only THREE, words; only three\nwords"), (7, items[8][1]), (8, items[9][1].replace(" ", "--"))]
    docs += [(10 + k, some(60)) for k in range(8)] + [(30, some(3000)), (31, f"{some(40)} {items[11][1]} {items[11][1]}"), (None, items[0][1]), (None, None)]
    docs += [docs[3], docs[3], docs[0]]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_leaks_equal_brute_force(spark, monkeypatch, small):
    if small:  # many automata and passes, items in pieces
        monkeypatch.setattr(decontamination, "SHARD_WORDS", 60)
        monkeypatch.setattr(decontamination, "PIECE_WORDS", 25)
        monkeypatch.setattr(decontamination, "PASS", 2)
    docs, items = leaky_tables()
    df = spark.createDataFrame([(*r, 3, "i", 4, "t") for r in docs], DOCS).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontamination.find_leaks(df, bench).collect())
    assert got == Counter((i, n, len(h), tuple(f)) for i, n, h, f in leaks(docs, items))
    assert decontamination.find_leaks(df.limit(0), bench).count() == 0
    clean = decontamination.find_leaks(df, bench.limit(0)).collect()
    assert len(clean) == len(docs) and all(r.n_hit == 0 and r["items"] == [] for r in clean)


def test_leaks_are_cut_and_covered_documents_dropped(spark):
    rows = [(1, "Before it: one two three four, after.", 5), (2, "one two three four", 6), (3, None, 7), (4, "nothing here", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, items int")
    bench = spark.createDataFrame([(1, "one two three"), (2, "TWO three Four")], "item_id long, text string")
    got = decontamination.remove_leaks(df, bench, window=3, coverage=0.6)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == sorted([(1, "Before it: , after.", 5), (3, None, 7), (4, "nothing here", 8)], key=lambda r: r[0])


def test_automaton_tracks_longest_matches():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 4, n).astype(np.uint64) for n in (40, 3, 25, 40)]
    auto = decontamination.Automaton.read(decontamination.Automaton.of(seqs, [1, 2, 3, 4], [True] * 4, 5).bytes())
    text = rng.integers(0, 5, 3000).astype(np.uint64)
    pos, size, window = auto.matches(text, np.array([0, 1000, 1000, 3000]))
    have = {(int(p), int(n), int(i)) for p, n, w in zip(pos, size, window, strict=True) for i in auto.item[auto.first[w] : auto.first[w + 1]]}
    want = set()
    for i, s in zip([1, 2, 3, 4], seqs, strict=True):
        n = min(5, len(s))
        for a in range(len(s) - n + 1):
            for p in range(n - 1, len(text)):
                if (text[p - n + 1 : p + 1] == s[a : a + n]).all() and (p >= 1000) == (p - n + 1 >= 1000):
                    want.add((p, n, i))
    assert have == want and len(want) > 100


# conversations

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
BLANKS = " \t\n\x0b\f\r"


def blank(x):
    return " " if x is None else str(x)


def repaired(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (role, text) of (turn, role, text) rows, by trying all edits."""
    z = sorted(((t, blank(r), blank(x)) for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    turns = {t for t, *_ in z if t is not None}
    seen, fault = set(), []
    for _, role, text in z:
        solid = text.strip(BLANKS)
        fault.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.lru_cache(None)
    def go(i, s, ins):
        if ins > 3:
            return 10**9, "", ()
        turn = 3 if s == 2 else 2
        other = "user" if turn == 2 else "assistant"
        c, a, o = go(i, turn, ins + 1)
        found = [(c + 2, "I" + a, ((other, ""), *o))]
        if i == len(z):
            return min(found + [(0, "", ())] * (s in (0, 3)))
        c, a, o = go(i + 1, s, 0)
        found.append((c + 3, "D" + a, o))
        if fault[i] in ("", "t"):
            cut, (_, role, text) = int(fault[i] == "t"), z[i]
            c, a, o = go(i + 1, turn, 0)
            found.append((c + 2 + cut, "R" + a, ((other, text), *o)))
            if (s, role[:1]) in STEP:
                c, a, o = go(i + 1, STEP[s, role[:1]], 0)
                found.append((c + cut, "K" + a, ((role, text), *o)))
        return min(found, key=lambda f: f[:2])

    cost, audit, out = go(0, 0, 0)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(z, z[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, out


def digest(out):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def talk(n=60):
    rng = random.Random(12)
    rows = []
    for c in [*range(n), None]:
        for t in sorted(rng.sample(range(-3, 12), rng.randint(0, 9))):
            for _ in range(1 + (rng.random() < 0.1)):
                rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), rng.choice(["Yes.", "No!", "Why?", "cut off", "", " \x0b\f", None, "f", "yes.\n \x0c", "Ähm ", "no"])))
    return [*rows, *rows[:5]]


TURNS = "conv_id long, turn long, role string, text string, times int, first int, h int"


@pytest.mark.parametrize("held", [conversations.HELD, 150])  # the second one spills after every row or two
def test_repairs_equal_brute_force(spark, held):
    rows = talk()
    df = spark.createDataFrame([(*r, 9, 9, 9) for r in rows], TURNS).repartition(3)
    by = defaultdict(list)
    for c, *r in rows:
        by[c].append(tuple(r))
    want = {c: repaired(r) for c, r in by.items()}
    got = {r.conv_id: r for r in conversations.audit_conversations(df, held=held).collect()}
    assert got.keys() == want.keys()
    for c, w in want.items():
        r = got[c]
        assert (r.n_rows, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == (len(by[c]), *w[:7], digest(w[7])), c
    out = defaultdict(list)
    for r in conversations.repair_conversations(df, held=held).orderBy("position").collect():
        assert r.position == len(out[r.conv_id])
        out[r.conv_id].append((r.role, r.text))
    assert dict(out) == {c: list(w[7]) for c, w in want.items() if w[7]}
    assert conversations.audit_conversations(df.limit(0)).count() == 0


def test_damaged_conversations_equal_brute_force(spark):
    rows = [*talk(200), (1000, 3, "user", "x"), (1001, None, None, None)]
    by = defaultdict(list)
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        by[c] += [(t, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    want = {c: repaired(r) for c, r in by.items()}
    df = spark.createDataFrame([(*r, 9, 9, 9) for r in rows], TURNS).repartition(2)
    got = {r.conv_id: r for r in conversations.audit_conversations(conversations.damaged(df), times="times").collect()}
    assert {c: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for c, r in got.items()} == {c: (*w[:7], digest(w[7])) for c, w in want.items()}
    assert any(not r for r in by.values())  # a conversation that loses all its rows


def test_a_giant_conversation_is_spilled(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"{t}.") for t in range(20_000)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.conv_id: r for r in conversations.audit_conversations(df, held=100_000).collect()}
    assert got[1].audit == "K" * 20_000 and got[1].cost == 0 and got[1].repaired_sha256 == digest([r[2:] for r in rows[:20_000]]) and got[2].audit == "KK"


# spelling


def spelled(rows, least=7, damage=31):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and v != w and one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        if near[w] and n[best := min(near[w], key=lambda v: (-n[v], v))] >= 10 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def spelling_rows():
    rng = random.Random(13)
    words = ["recieve", "receive", "receives", "éléphant", "elephant", "éléphants", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "baaaaaa", "ÀÖØöøÿ×", "Straßen", "strassen", "x" * 200, "x" * 201, "x" * 199 + "y", "y" + "x" * 199]
    words += ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(250)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "x" * 30000 + " " + "x" * 29999), (103, "x" * 30000 + "\n" + "x" * 29999), (None, "receive " * 700 + "recxive recxive"), (104, "Receive" * 2)]
    rows += [(105, "kitchens " * 3 + "kitchenx " * 40 + "kitchenxy " * 900 + "kitchenxyz, " * 9500)]
    return [*rows, rows[0], rows[0]]


@pytest.mark.parametrize("block", [spelling.BLOCK, 3])
def test_variants_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = spelling_rows()
    n = spelled(rows)
    df = spark.createDataFrame([(*r, 1, "w", 2) for r in rows], "doc_id long, text string, n int, word string, key int").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spelling.vocabulary(df, damage=31)).collect()}
    want = grouped(n)
    assert got == want
    assert sum(w[0] is not None for w in want.values()) > 3 and any(w[0] and w[0] != w[1] for w in want.values())


def test_variants_of_undamaged_texts_and_of_none(spark):
    df = spark.createDataFrame([(1, "Abcdefg abcdefg abcdefgh abcdefgh short short")], "doc_id long, text string")
    assert sorted((r.word, r.n, r.n_near) for r in spelling.variants(spelling.vocabulary(df)).collect()) == [("abcdefg", 2, 1), ("abcdefgh", 2, 1)]
    assert spelling.variants(spelling.vocabulary(df.limit(0))).count() == 0


def test_tiles_that_go_on_in_the_next_batch_wait(monkeypatch):
    monkeypatch.setattr(spelling, "ROWS", 4)
    words = [f"abcde{x}{y}" for x in "abc" for y in "abc"]
    cols = {"key": [1] * 3 + [5] * 9, "bi": [0] * 12, "bj": [0] * 12, "own": [0] * 12, "s": [7] * 12, "i": [0] * 3 + [2] * 9, "word": [*words[:3], *words], "n": [2] * 12}
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
    batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), types, strict=True)], list(cols))
    got = Counter((a, b) for out in spelling._near(batch.slice(k, 2) for k in range(0, 12, 2)) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    assert got == Counter((a, b) for a in words for b in words if one_edit(a, b) and a[5] != b[5])  # the window of code points 4 and 5


def test_checksums_are_those_of_zlib():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 300)
    end = start + rng.integers(0, 100, 300)
    got = spelling.checksums(data, start, end, np.full(300, zlib.crc32(b"12:")))
    assert got.tolist() == [zlib.crc32(b"12:" + data[a:e].tobytes()) for a, e in zip(start, end, strict=True)]


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_conversation_repair", "op13_spelling_variants"])
def test_queries_equal_their_statements(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    statement = {"op11": oracles.DECONTAMINATION, "op12": oracles.CONVERSATIONS, "op13": oracles.SPELLING}[name[:4]]
    want = con.sql(statement)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())
