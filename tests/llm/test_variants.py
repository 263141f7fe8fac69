"""SimHash, spelling variants and source divergence against brute force, and their edge cases."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from tidesync.llm import divergence, queries, simhash, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, fp string, word string, cell string, slice string, n long"
NEW = ["op11_simhash", "op12_spelling", "op13_divergence"]
ODD = [
    (1, None, None, None), (2, "", "", ""), (3, "one", "en", "a"), (4, " \t\n", "en", "b"), (5, "a b c", "en", None),
    (6, "a b c", "en", "a"), (None, "a b c", None, "a"), (2, "", "", ""), (8, "Überlänge ß 漢字 wordy " * 4000, "de", "a"),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, lang, src, "x", "y", "z", "0", 7) for d, t, lang, src in rows], DOCS)


def texts(spark, values):
    return docs_of(spark, [(i + 1, t, "en", "s") for i, t in enumerate(values)])


@pytest.mark.parametrize("name", ["op12_spelling", "op13_divergence"])
def test_oracle_on_the_given_table(spark, name):
    got = [tuple(r) for r in queries.REGISTRY[name](spark, SF).collect()]
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE[name])
    cols = queries.REGISTRY[name](spark, SF).columns
    assert cols == want.columns
    key = lambda row: tuple(map(str, row))
    assert sorted(got, key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", NEW)
def test_odd_and_empty_tables(spark, name, tmp_path):
    docs_of(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.REGISTRY[name](spark, str(tmp_path))
    rows = out.collect()
    if name == "op11_simhash":
        assert len(rows) == len(ODD)
    empty = tmp_path / "empty"
    docs_of(spark, ODD).limit(0).write.parquet(f"{empty}/documents.parquet")
    none = queries.REGISTRY[name](spark, str(empty))
    assert none.count() == 0 and none.dtypes == out.dtypes


# ---- SimHash ---------------------------------------------------------------------------------------


def slow_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        parent[find(a)] = find(b)
    return {x: find(x) for x in nodes}


def test_fingerprint_equals_its_definition(spark):
    r = np.random.RandomState(3)
    values = [None, "", "A", "a B", "Ärger ÄRGER x y z", "x" * 100_000] + [
        " ".join(f"W{x}" for x in r.randint(0, 50, n)) for n in (2, 3, 4, 50, 3000)
    ]
    out = {row["doc_id"]: row["fingerprint"] for row in simhash.simhash_groups(spark, texts(spark, values)).collect()}
    assert [out[i + 1] for i in range(len(values))] == [f"{slow_print(t):016x}" for t in values]
    chunk, simhash.CHUNK = simhash.CHUNK, 7
    try:
        assert [simhash.fingerprint(t or "") for t in values] == [slow_print(t) for t in values]
    finally:
        simhash.CHUNK = chunk


def near_prints(seed, families, size):
    """Families of fingerprints, some of them chains of two-bit steps."""
    r = np.random.RandomState(seed)
    out = []
    for _ in range(families):
        x = int(r.randint(0, 2**63, dtype=np.int64))
        for _ in range(r.randint(1, size)):
            out.append(x - (1 << 63))
            for b in r.randint(0, 63, r.randint(1, 5)):
                x ^= 1 << int(b)
    return sorted(set(out))


@pytest.mark.parametrize("tile", [1024, 8])
def test_links_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    prints = near_prints(1, 60, 12) + [0, 1, 3, -1, -2]
    links = simhash.close_links(spark, spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    u = np.array(prints, np.int64).view(np.uint64)
    all_links = [(prints[i], prints[j]) for i in range(len(u)) for j in range(i) if (int(u[i]) ^ int(u[j])).bit_count() <= 2]
    assert {(min(a, b), max(a, b)) for a, b in map(tuple, links)} <= {(min(x), max(x)) for x in all_links}
    got, want = classes(prints, map(tuple, links)), classes(prints, all_links)
    for a in prints:
        assert [b for b in prints if got[a] == got[b]] == [b for b in prints if want[a] == want[b]]


def test_a_dense_family_leaves_a_spanning_forest():
    close = np.ones((300, 200), bool)
    assert len(simhash.spanning(close)) == 499
    same = ~np.eye(300, dtype=bool)
    assert len(simhash.spanning(same)) < 600
    assert simhash.spanning(np.zeros((3, 4), bool)) == []


def test_components_carry_the_smallest_id(spark):
    rows = [(5, "same text here", "en", "s"), (None, "same text here", "en", "s"), (3, "SAME text\nhere", "en", "s"), (9, None, "en", "s"), (None, "alone in this", "en", "s")]
    out = simhash.simhash_groups(spark, docs_of(spark, rows)).collect()
    by = defaultdict(set)
    for row in out:
        by[row["fingerprint"]].add((row["doc_id"], row["component_id"]))
    assert by["0" * 16] == {(9, 9)}
    assert by[f"{slow_print('same text here'):016x}"] == {(5, 3), (None, 3), (3, 3)}
    assert by[f"{slow_print('alone in this'):016x}"] == {(None, None)}


def test_a_third_of_the_rows_in_one_fingerprint(spark):
    values = ["hot text " * 20] * 400 + [f"text number {i} of many" for i in range(800)]
    out = simhash.simhash_groups(spark, texts(spark, values)).collect()
    assert len(out) == 1200 and sum(row["component_id"] == 1 for row in out) >= 400


# ---- spelling ------------------------------------------------------------------------------------


def slow_words(rows):
    n = Counter()
    for d, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_spelling(n):
    out = {}
    for w in n:
        near = [v for v in n if v != w and one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v.encode()), default=None)
        out[w] = [best if best and n[best] >= 2 * n[w] else None, None, n[w], len(near)]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return {(w, f, r, k, m, n.get(f)) for w, (f, r, k, m) in out.items()}


def spelled(spark, rows):
    return {tuple(r) for r in spelling.spelling_groups(spark, docs_of(spark, rows)).collect()}


def test_spelling_equals_brute_force(spark):
    r = np.random.RandomState(5)
    base = ["aaaaa", "aaaab", "aaaaaa", "abaab", "baaaa", "aabab", "ÄÖaaa", "äöaaa", "ÿaaaa", "Straße", "strasse", "ABaab"]
    vocab = base + ["".join(r.choice(list("abé"), r.randint(4, 8))) for _ in range(150)]
    rows = [(None if d % 7 == 0 else d, " 1-2 ".join(r.choice(vocab, 60)), "en", "s") for d in range(60)]
    rows += rows[:3] + [(7, None, "en", "s"), (8, "", "en", "s")]
    assert spelled(spark, rows) == slow_spelling(slow_words(rows))


def test_chains_of_forms_reach_their_root(spark):
    words = ["aaaaa" + "bcdefghijkl"[:i] for i in range(9)]                    # each one letter longer
    rows = [(1000 + i, " ".join([w] * 3 * 2**i), "en", "s") for i, w in enumerate(words)]
    n = slow_words(rows)
    got = spelled(spark, rows)
    assert got == slow_spelling(n)
    assert {r for w, _, r, *_ in got if w in words} == {words[-1]}


def test_ties_take_the_smallest_word_and_doubling_decides(spark):
    rows = [(1000, "zebra " * 3 + "zebrb " * 6 + "zebrc " * 6 + "zebrd " * 5, "en", "s")]
    assert spelled(spark, rows) == slow_spelling(slow_words(rows))


# ---- divergence --------------------------------------------------------------------------------------


def slow_divergence(rows, scale=10**9):
    docs = [((lang or ""), (src or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, src in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, k in df.items() if k >= 3]
        sources = sorted({d[1] for d in mine})
        c = {s: Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= 3) for s in sources}
        v = len(kept)

        def probs(counts):
            total = sum(counts.values())
            return {t: 1 + scale * (counts[t] + 1) // (total + v) for t in kept}

        whole = probs(sum(c.values(), Counter()))
        p = {s: probs(c[s]) for s in sources}
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - whole[t]) ** 2 // whole[t]) for t in kept if c[s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, val, k + 1) for k, (i, val) in enumerate(ranked) if part == "pair" or k < 200}
    return out


def random_rows(seed, n):
    r = np.random.RandomState(seed)
    vocab = ["Aa", "bB", "Ünï", "漢字", "x1y", "don't", "z-"] + [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for d in range(n):
        src = "hot" if d % 3 == 0 else f"s{r.randint(6)}"
        rows.append((d, " ".join(r.choice(vocab, r.randint(0, 40))), r.choice(["en", "de", None]), None if d % 11 == 0 else src))
    return rows + [(n, None, "xx", "only"), (n + 1, "rare words", "yy", "a"), (n + 2, "", "yy", "b")]


@pytest.mark.parametrize("spill, slice_size", [(200_000, 1024), (50, 16)])
def test_divergence_equals_brute_force(spark, monkeypatch, spill, slice_size):
    rows = random_rows(2, 150)
    want = slow_divergence(rows)
    folded = divergence._folded
    if spill == 50:
        whole = docs_of(spark, rows).select("text", "lang", "source").na.fill("").toArrow()
        monkeypatch.setattr(divergence, "SPILL_CELLS", spill)
        parts = list(folded(iter(whole.to_batches(max_chunksize=5))))
        assert max(p.num_rows for p in parts) < 50 + 40                       # a document at most beyond the bound
    monkeypatch.setattr(divergence, "SLICE", slice_size)
    got = {tuple(r) for r in divergence.source_divergence(spark, docs_of(spark, rows)).collect()}
    assert got == want


def test_counts_beyond_64_bits_stay_exact():
    import pandas as pd

    big = 3 * 10**10
    stripes = pd.DataFrame({"lang": ["en"] * 2, "term": ["a", "b"], "sources": [["s", "t"], ["s"]], "counts": [[big, 1], [5]], "slice": [1, 1]})
    totals = pd.DataFrame({"lang": ["en"] * 2, "source": ["s", "t"], "total": [big + 5, 1], "v": [2, 2], "slices": [1, 1], "slice": [1, 1]})
    out = divergence._divergences(("en", 1), stripes, totals)
    got = {(r.part, r.source, r.item): r.value for r in out.itertuples()}

    def p(c, n):
        return 1 + 10**9 * (c + 1) // (n + 2)

    f = sum((p(a, big + 5) - p(b, 1)) ** 2 // p(b, 1) for a, b in ((big, 1), (5, 0)))
    assert got["pair", "s", "t"] == f


# ---- near duplicates: groups close to the threshold ------------------------------------------------


def five_word_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_classes(values):
    sets = [five_word_set(t) for t in values]
    linked = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    return classes(range(len(values)), linked), len(linked)


def family(seed, n, length, edits):
    r = np.random.RandomState(seed)
    base = [f"w{x}" for x in r.randint(0, 10**6, length)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in r.choice(length, edits, replace=False):
            w[at] = f"e{r.randint(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_groups_at_the_threshold_match_brute_force(spark):
    from tidesync.llm import near_dedup

    values = family(1, 40, 150, 2) + family(2, 60, 220, 3) + family(3, 30, 40, 1) + family(4, 30, 60, 1) + family(5, 20, 300, 4)
    want, linked = near_classes(values)
    assert 500 < linked < 0.9 * sum(n * (n - 1) / 2 for n in (40, 60, 30, 30, 20))
    out = {r["doc_id"] - 1: r["component_id"] - 1 for r in near_dedup.near_groups(spark, texts(spark, values)).collect()}
    least = {}
    for i, c in want.items():
        least.setdefault(c, i)
    assert out == {i: least[c] for i, c in want.items()}


def test_short_texts_at_the_threshold_are_linked(spark):
    from tidesync.llm import near_dedup

    r = np.random.RandomState(8)
    values = []
    for k in range(150):                                     # unions of 4 to 20 shingles, similarity 0.75 and just above
        n = int(r.randint(4, 21))
        base = [f"p{k}w{i}" for i in range(n + 3)]
        values += [" ".join(base), " ".join(base[: n + 3 - max(1, n // 4)])]
    want, linked = near_classes(values)
    assert linked >= 100
    out = {x["doc_id"] - 1: x["component_id"] - 1 for x in near_dedup.near_groups(spark, texts(spark, values)).collect()}
    assert {i for i in out if out[i] != i} == {i for i in want if any(j < i and want[j] == want[i] for j in want)}


def test_residual_links_grow_with_the_members(spark, monkeypatch):
    """A family close to the threshold: what the residual step writes follows its members, not their pairs."""
    from tidesync.llm import near_dedup

    made = {}
    plain = near_dedup.pinned

    def counting(s, df, purpose):
        out = plain(s, df, purpose)
        made[purpose] = max(made.get(purpose, 0), out.count())
        return out

    monkeypatch.setattr(near_dedup, "pinned", counting)
    rows = []
    for n in (100, 200, 400):
        made.clear()
        near_dedup.near_groups(spark, texts(spark, family(6, n, 215, 3))).count()
        rows.append(sum(made.get(p, 0) for p in ("near-set-blocks", "near-wanted", "near-rest-links")))
    assert rows[2] < 6 * max(rows[0], 50)
