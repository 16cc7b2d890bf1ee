"""Spelling variants, conversation tries and repeated windows against plain definitions, on odd and crowded input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from candleforge.llm import prefix_trie, spelling, substring_dedup
from candleforge.llm.shared import Scratch

DOCS = "doc_id long, text string, word string, n int, start int, a long, mask long"


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "w", 1, 2, 3, 4) for i, t in rows], DOCS).repartition(parts)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# repeated windows


def brute_repeats(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    places = defaultdict(list)
    for d, w in enumerate(words):
        for i in range(len(w) - width + 1):
            places[tuple(w[i : i + width])].append((d, i))
    gone = [set() for _ in rows]
    for at in places.values():
        if len(at) > 1:
            for d, i in at:
                gone[d].update(range(i, i + width))
    return sorted(((rows[d][0], len(w), len(gone[d]), " ".join(x for i, x in enumerate(w) if i not in gone[d])) for d, w in enumerate(words)), key=repr)


def repeat_rows():
    rng = random.Random(3)
    new = lambda n: " ".join(f"{rng.choice('abcdé')}{rng.randrange(400)}" for _ in range(n))
    passage, copy = new(60), new(150)
    rows = [(i, f"{new(rng.randrange(40))}\n{passage}\t{new(rng.randrange(80))}") for i in range(40)]
    rows += [(100 + i, copy) for i in range(30)] + [(200, copy + " tail"), (200, copy), (200, copy), (None, copy), (None, new(50)), (None, new(50))]
    rows += [(300, "la " * 300), (301, "la le " * 30), (302, None), (303, ""), (304, " \n "), (305, new(34)), (306, passage.upper()), (307, new(5000)), (308, "ex" * 50_000 + " " + new(40))]
    rows += [(309, " ".join(passage.split()[:35])), (310, " ".join(passage.split()[1:35])), (311, "x y " * 40)]
    return rows


@pytest.mark.parametrize(("width", "run", "hot"), [(35, 6, 512), (35, 6, 2), (5, 2, 7), (35, 30, 1)])
def test_repeated_windows_equal_brute_force(spark, width, run, hot):
    rows = repeat_rows()
    with Scratch(spark) as scratch:
        found = substring_dedup.remove_repeats(docs_of(spark, rows), scratch, width, run, hot)
        got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in found.collect()]
        spans = {r.doc_id: r.removed for r in found.where("doc_id = 300").collect()}
    assert sorted(got, key=repr) == brute_repeats(rows, width)
    assert [(s.first, s.words) for s in spans[300]] == [(0, 300)]


def test_repeats_of_an_empty_table(spark):
    with Scratch(spark) as scratch:
        assert substring_dedup.remove_repeats(docs_of(spark, []), scratch).collect() == []


def test_super_kmers_hold_every_window_once_and_meet_by_content():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 6, 400).astype(np.uint64) * np.uint64(7919)
    first, last = np.array([0, 30, 30, 200]), np.array([30, 30, 200, 400])
    start, n, value, weight = substring_dedup.super_kmers(h, first, last, 9, 3)
    held = np.concatenate([np.arange(s, s + k) for s, k in zip(start, n, strict=True)])
    assert held.tolist() == [i for a, b in zip(first, last, strict=True) for i in range(a, b - 9 + 1)]
    by_words, weights = defaultdict(set), Counter()
    for s, k, v, w in zip(start.tolist(), n.tolist(), value.tolist(), weight.tolist(), strict=True):
        assert k <= 7
        weights[v] += w
        for i in range(s, s + k):
            by_words[tuple(h[i : i + 9])].add(v)
    assert all(len(v) == 1 for v in by_words.values())
    windows = Counter(tuple(h[i : i + 9]) for i in held)
    assert all(weights[next(iter(by_words[w]))] > 1 for w, k in windows.items() if k > 1)


def test_windows_under_one_hash_are_told_apart_by_their_words(monkeypatch):
    packed = [b"a b c d", b"x b c d", b"a b c e"]
    want = substring_dedup.repeated_windows(packed, 3)[0].tolist()
    monkeypatch.setattr(substring_dedup, "_rolled", lambda h, k, by=None: np.zeros(max(0, len(h) - k + 1), np.uint64))
    assert want == [3, 2, 1] == substring_dedup.repeated_windows(packed, 3)[0].tolist()


# conversation tries


def brute_nodes(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    leaf = {k: not any(m[:-1] == k and m for m in members if len(m) == len(k) + 1) for k in members}
    out = []
    for k, m in members.items():
        below = [v for v in members if v[: len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), sum(len(v) == len(k) + 1 for v in below), sum(leaf[v] for v in below), sum((len(members[v]) - 1) * len(v[-1][1]) for v in below if v), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversation_rows():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 60), *range(98, 140), 250, 251, 252, -5, -100, -103]:
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "hí", "yes", "", None, "a long answer"])))
    rows += [(300 + i, t, "user", f"same {t}") for i in range(12) for t in range(20)]
    return [*rows, rows[0], rows[0], (None, 1, "user", "lost"), (5, 0, "user", "hi"), (5, 0, "assistant", "hi"), (400, 1, "u", "x" * 100_000)]


@pytest.mark.parametrize("heavy", [1024, 20, 0])
def test_trie_nodes_equal_brute_force_and_sql(spark, heavy):
    rows = conversation_rows()
    shape = "conv_id long, turn long, role string, text string, digest string, depth int, n int"
    table = spark.createDataFrame([(*r, "d", 1, 2) for r in rows], shape).repartition(3)
    with Scratch(spark) as scratch:
        got = collected(prefix_trie.trie_nodes(prefix_trie.rebuilt(prefix_trie.sequences(table)), scratch, heavy))
    assert got == brute_nodes(rows)
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(db.sql(prefix_trie.ORACLE_SQL).fetchall(), key=repr) == got


def test_tries_of_empty_tables_and_empty_sequences(spark):
    shape = "conv_id long, turn long, role string, text string"
    with Scratch(spark) as scratch:
        assert prefix_trie.trie_nodes(prefix_trie.sequences(spark.createDataFrame([], shape)), scratch).collect() == []
        alone = next(c for c in range(1, 500) if c % 100 and zlib.crc32(str(c).encode()) % 6 == 4)
        one = spark.createDataFrame([(alone, 0, "user", "x")], shape)
        got = prefix_trie.trie_nodes(prefix_trie.rebuilt(prefix_trie.sequences(one)), scratch).collect()
    assert [tuple(r) for r in got] == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_louds_bits_give_back_parents_and_children():
    labels = np.array([[1, 1], [2, 2], [3, 3], [1, 1], [2, 2], [4, 4], [1, 1], [9, 9]], np.uint64)
    begin, length = np.array([0, 3, 6]), np.array([3, 3, 2])
    trie = prefix_trie.louds(np.zeros(3, np.int64), np.ones(3, np.int64), labels, np.arange(8), begin, length, np.array([2, 1, 1]), np.array([7, 3, 5]))
    assert trie["bits"].tolist() == [1, 1, 0, 1, 1, 0, 0, 0, 0]
    parent, children, roots = prefix_trie.parents(np.packbits(trie["bits"]), 5)
    assert (parent.tolist(), children.tolist(), roots) == ([0, 0, 1, 1], [2, 2, 0, 0, 0], 1)
    assert trie["members"].tolist() == [4, 3, 1, 2, 1] and trie["least"].tolist() == [3, 3, 5, 7, 3] and trie["labels"][:, 0].tolist() == [1, 2, 9, 3, 4]


# spelling variants


def brute_forms(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def edits(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and edits(v, w)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) if v else None for w, v in near.items()}
    form = {w: b if b and words[b] >= 2 * words[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()), key=repr)


def spelling_rows():
    rng = random.Random(8)
    pool = ["".join(rng.choice("abÀé") for _ in range(rng.randint(4, 8))) for _ in range(150)]
    pool += ["prefix" + "".join(rng.choice("abc") for _ in range(3)) + "suffix" for _ in range(40)] + ["z" * 60, "z" * 61, "z" * 59 + "y", "Straße", "strasse", "aaaaa", "aaaaaa", "naïve", "naive"]
    weight = [rng.choice([1, 1, 3, 10, 40]) for _ in pool]
    rows = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(pool, weight, k=120))) for i in range(60)]
    return [*rows, rows[0], rows[0], (None, "naive naive naive"), (7, None), (8, ""), (9, "a1b2 ×÷ word-word_word"), (10, "Āb " + "longest" * 3000)]


@pytest.mark.parametrize("hot", [2000, 3])
def test_spelling_groups_equal_brute_force_and_sql(spark, hot):
    rows = spelling_rows()
    with Scratch(spark) as scratch:
        got = collected(spelling.spelling_groups(docs_of(spark, rows), scratch, hot))
    assert got == brute_forms(rows)
    assert sum(r[1] is not None for r in got) > 20 and any(r[2] != r[1] for r in got if r[1])
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", rows)
    assert sorted(db.sql(spelling.ORACLE_SQL).fetchall(), key=repr) == got


def test_no_words(spark):
    with Scratch(spark) as scratch:
        assert spelling.spelling_groups(docs_of(spark, [(1, None), (2, "one two")]), scratch).collect() == []
        assert spelling.spelling_groups(docs_of(spark, []), scratch).collect() == []


def test_one_edit():
    assert all(spelling.is_one_edit(*p) for p in (("abcde", "abxde"), ("abcde", "abcdef"), ("abcde", "bcde"), ("aab", "aaab")))
    assert not any(spelling.is_one_edit(*p) for p in (("abcde", "abcde"), ("abcde", "abdce"), ("abcde", "abcdefg"), ("abcde", "xabcd")))
