"""Conversation repair, SimHash anchors and hard negatives against brute force, and words that weak hashes confuse."""

import collections
import functools
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import oracle
from utterflow.llm import conversations, frames, hard_negatives, kernels, near_dedup, queries, simhash, substring_dedup, tokens
from utterflow.llm.oracles import ORACLE_SQL

SMALL = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


# --- words that differ only in the order of their letters

def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [64, 1024, 2048, 5000])
def test_span_hashes_tell_mirrored_words_apart(n):
    word = thue_morse(n)
    data = (word + word.translate(str.maketrans("ab", "ba")) + word).encode()
    h = kernels.span_hashes(np.frombuffer(data, np.uint8), np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert h[0] == h[2] != h[1]
    near = kernels.span_hashes(np.frombuffer(b"abcabdab", np.uint8), np.array([0, 3, 6]), np.array([3, 6, 8]))
    assert len(set(near.tolist())) == 3


def test_mirrored_words_are_different_documents(spark):
    a, b = thue_morse(2048), thue_morse(2048, "ba")
    df = spark.createDataFrame([(1, a), (2, b), (3, a), (4, f"{a} x " * 30), (5, f"{b} x " * 30)], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    assert {tuple(r.kept_doc_ids) for r in substring_dedup.repeated_spans(df).collect()} <= {(4,), (5,)}


def test_mirrored_words_have_their_own_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    words = [thue_morse(1024, x + y) for x, y in itertools.permutations("abcdexyz", 2)]
    rows = [(i, w) for i, w in enumerate(words)] + [(100, " ".join(words))]
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), path).collect()}
    assert got == {i: len(whole.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_equal_hashes_are_compared_byte_by_byte(monkeypatch):
    monkeypatch.setattr(tokens, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"abcabdababc", np.uint8)
    starts, ends = np.array([0, 3, 6, 8]), np.array([3, 6, 8, 11])
    at, back = tokens._groups(data, starts, ends)
    assert [bytes(data[starts[at[k]] : ends[at[k]]]) for k in back] == [b"abc", b"abd", b"ab", b"abc"]


# --- 11

def repaired(rows):
    """All contract columns of one conversation's original rows (conv, turn, role, text), by the definition."""
    conv = rows[0][0] if rows else None
    text = lambda v: " " if v is None else str(v)
    kept = []
    for _, turn, role, t in rows:
        h = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, t = text(role), text(t)
        t = "" if h == 1 else "".join(c for c in t if c not in ".!?") if h == 2 else t
        role = "user" if h == 4 else role
        kept += [(turn, role, t)] * (0 if h == 0 else 2 if h == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, t in kept:
        body = t.strip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, t) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, t))
    turns = {r[0] for r in kept} - {None}
    initials = [r[1][:1] for r in kept]
    takes = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    name = {"u": "user:", "a": "assistant:"}

    @functools.lru_cache(None)
    def best(i, q, inserted):
        ways = [(0, "", ())] if i == len(kept) and q in (0, 3) else []
        add = lambda c, letter, line, rest: ways.append((c + rest[0], letter + rest[1], line + rest[2]))
        if i < len(kept):
            add(2, "D", (), best(i + 1, q, 0))
            if faults[i] in ("", "truncated"):
                more = 5 * (faults[i] == "truncated")
                if initials[i] in takes[q]:
                    add(more, "K", (f"{kept[i][1]}:{kept[i][2]}",), best(i + 1, takes[q][initials[i]], 0))
                for r in set(takes[q]) & set(name):
                    add(1 + more, "R", (name[r] + kept[i][2],), best(i + 1, takes[q][r], 0))
        if inserted < 3:
            for r in set(takes[q]) & set(name):
                add(5, "I", (name[r],), best(i, takes[q][r], inserted + 1))
        return min(ways) if ways else (1 << 40, "", ())

    for i in range(len(kept), 0, -200):
        best(i, 0, 0), best(i, 2, 0)
    cost, audit, lines = best(0, 0, 0)
    return (
        conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


CONVERSATION = "conv_id bigint, turn bigint, role string, text string"
FIGURES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def odd_conversations(rnd):
    rows = []
    for conv in [*range(300), None]:
        for turn in range(rnd.randint(0, 9)):
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "ué"])
            text = rnd.choice(["Hello there.", "Why? ", "Yes!", "no end", "", None, " \t\n", "Été. ", "same.", "same.", " ", "a.\r\n"])
            rows.append((conv, rnd.choice([turn, turn, turn + 3, turn // 2, None, -turn]), role, text))
    rows += [(1000, 0, "user", "A."), (1000, 0, "user", "A."), (1000, 0, "assistant", "B."), (1001, None, None, None), (-5, 3, "user", "x." * 50_000)]
    return rows


def figures(df):
    return sorted(((*(r[c] for c in FIGURES),) for r in df.collect()), key=repr)


def test_conversations_equal_the_definition(spark):
    rows = odd_conversations(random.Random(21))
    df = spark.createDataFrame(rows, CONVERSATION).withColumns({"copies": F.lit("clash"), "fault": F.lit(7), "name": F.lit(1), "first": F.lit(2)}).repartition(3)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    assert figures(conversations.damaged_and_repaired(df)) == sorted(map(repaired, groups.values()), key=repr)
    assert conversations.damaged_and_repaired(df.limit(0)).count() == 0


def test_giant_conversation_spills_its_backpointers(spark, monkeypatch):
    monkeypatch.setattr(conversations, "HELD", 1 << 10)
    one = conversations.Repair()
    rnd = random.Random(22)
    rows = [(7, t, rnd.choice(["user", "assistant", "system"]), f"t{t}" + rnd.choice([".", "", "!"])) for t in range(3000)]
    kept = [(r, h) for r in rows if (h := zlib.crc32(f"7:{r[1]}".encode()) % 20) > 0]
    want = repaired(rows)
    seen = set()
    for (_, turn, role, text), h in kept:
        text = "" if h == 1 else text.rstrip(".!?") if h == 2 else text
        role = "user" if h == 4 else role
        for _ in range(1 + (h == 3)):
            fault = conversations.BLANK_ROW if not text else conversations.REPEATED_ROW if (role, text) in seen else conversations.GOOD_ROW if text[-1] in ".!" else conversations.CUT_ROW
            seen.add((role, text))
            one.add(turn, role, text, fault)
    assert one.back.file and len(one.back.last) < 300
    assert one.result() == want[1:]
    assert figures(conversations.damaged_and_repaired(spark.createDataFrame(rows, CONVERSATION).repartition(4))) == [want]


# --- 12

def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").translate({ord(c): " " for c in WHITE}).split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """Least ids of (id, fingerprint) rows by the definition: all pairs of fingerprints, and ids that repeat."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(b)] = find(a)
    by_id = {}
    for i, f in rows:
        if i is not None:
            parent[find(f)] = find(by_id.setdefault(i, f))
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f"{f:016x}", least.get(find(f))) for i, f in rows]


def test_simhash_equals_all_pairs(spark):
    rnd = random.Random(23)
    vocabulary = [f"w{k}" for k in range(300)] + ["Été", "ÀÉ", "ZZ"]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 40))) for _ in range(60)]
    base = " ".join(rnd.choices(vocabulary, k=600))
    for _ in range(150):  # near copies, many of them within two bits of each other
        w = base.split()
        w[rnd.randrange(600)] = rnd.choice(vocabulary)
        texts.append(rnd.choice([" ", "\n", "  "]).join(w))
    texts += [None, "", " \t\n", "one", "One", "one  two", "ONE\ntwo", "a b a b a b a b", "x " * 20_000, "y" * 100_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, base), (None, base + " zz"), (None, "only one here"), (5, texts[7])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"fp": F.lit("clash"), "id": F.lit(1), "anchor": F.lit(2)}).repartition(3)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_duplicates(df).collect()), key=repr)
    want = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    assert got == sorted(want, key=repr)
    assert len({w[2] for w in want}) < len({w[1] for w in want}) - 20
    assert simhash.simhash_duplicates(df.limit(0)).count() == 0


def test_simhash_of_a_small_table(spark):
    docs = frames.table(spark, SMALL, "documents")
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()])
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in queries.op12_simhash(spark, SMALL).collect())) == sorted(want)


def test_anchors_are_not_broadcast(spark):
    """Spark sizes the anchors, 61 a fingerprint, like the fingerprints that they are made of."""
    fps = frames.saved(spark.range(2000).select(F.xxhash64("id").alias("fp")))
    assert "Broadcast" not in simhash.fingerprint_links(fps)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_anchors_cover_all_neighbours(distance):
    rng = np.random.default_rng(distance)
    fps = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    flips = [functools.reduce(lambda x, b: x ^ (1 << int(b)), rng.choice(64, distance, replace=False), 0) for _ in fps]
    others = fps ^ np.array(flips, np.uint64)
    home = simhash.home_anchors(fps)
    row, anchor = simhash.anchors_within(others, distance)
    reach = collections.defaultdict(list)
    for r, a in zip(row.tolist(), anchor.tolist()):
        reach[r].append(a)
    assert all(h in reach[k] and len(set(reach[k])) == len(reach[k]) for k, h in enumerate(home.tolist()))


# --- 13

def plain_negatives(rows, percent=80):
    """Contract rows of (id, vector, label) by all pairs; the label is as given."""
    use = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            use.append((i, tuple(int(np.floor(256 * x)) for x in v), label))
    use = sorted(set(use))
    dim = max((len(v) for _, v, _ in use), default=1)
    m = np.array([[*v, *[0] * (dim - len(v))] for _, v, _ in use], np.int64).reshape(-1, dim)
    out = []
    for a, (i, _, label) in enumerate(use):
        if i % 100:
            continue
        score = (m @ m[a]).tolist()
        order = sorted(range(len(use)), key=lambda k: (-score[k], use[k][0]))
        positives = [k for k in order if use[k][2] == label and use[k][0] != i][:5]
        for p in positives:
            negatives = [k for k in order if use[k][2] != label and percent * score[p] <= 100 * score[k] <= 100 * score[p]][:5]
            out += [(i, use[p][0], r, use[k][0], score[p], score[k]) for r, k in enumerate(negatives, 1)]
    return sorted(set(out))


NEGATIVE = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(rows, spark, **more):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({"id": F.lit("clash"), "cid": F.lit(1), "vector": F.lit(2), "key": F.lit(3), "leaf": F.lit(0), "anchor": F.lit(5)}).repartition(3)
    return sorted({(*(r[c] for c in NEGATIVE),) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **more).collect()})


def odd_vectors(rnd, n=900, dim=12):
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rnd.choice(centres)
        rows.append((rnd.randrange(40) * 100 if i % 9 == 0 else i + 5000, [float(np.float32(x + rnd.gauss(0, 0.5))) for x in c], rnd.randint(0, 4)))
    hot = [0.5] * dim
    rows += [(10_000 + i, hot, i % 2) for i in range(300)]  # a vector that many rows share
    rows += [(20_000 + i, [0.25 * (i % 3)] * dim, i % 2) for i in range(40)]  # ties
    rows += [(1, None, 1), (2, [1.0, None], 1), (3, [float("nan")] * dim, 1), (4, [float("inf")] * dim, 1), (None, hot, 1), (6, hot, None), (7, hot[:3], 1), (300, [0.0] * dim, 1), (8, [], 0), (400, [-1.0] * dim, 9)]
    return rows + rows[:20]


@pytest.mark.parametrize("leaves", [1, 40])
def test_hard_negatives_equal_all_pairs(spark, leaves, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 50)
    monkeypatch.setattr(hard_negatives, "QUERY_ROWS", 3)
    rows = odd_vectors(random.Random(24))
    want = plain_negatives(rows)
    assert mined(rows, spark, leaves=leaves) == want and len(want) > 300
    if leaves == 1:
        assert mined(rows[:0], spark) == [] == mined([(100, [1.0], 1)], spark)


def test_tree_passes_over_leaves_that_cannot_hold_a_row():
    rng = np.random.default_rng(5)
    centres = rng.integers(-900, 900, (20, 16))
    rows = np.concatenate([c + rng.integers(-20, 20, (60, 16)) for c in centres])
    root, count = hard_negatives.grow(rows, 40)
    leaf, seen = hard_negatives.dealt(root, rows)
    low, high, norms = np.full((count, seen.shape[1]), np.inf), np.full((count, seen.shape[1]), -np.inf), np.tile([np.inf, -np.inf], (count, 1))
    square = (rows * rows).sum(1)
    for k in range(count):
        if (leaf == k).any():
            low[k], high[k], norms[k] = seen[leaf == k].min(0), seen[leaf == k].max(0), (square[leaf == k].min(), square[leaf == k].max())
    shape = (count, hard_negatives.LEVELS, hard_negatives.FAN)
    hard_negatives.set_ranges(root, low.reshape(shape), high.reshape(shape), norms)
    anchors = rows[::40]
    scores = anchors @ rows.T
    lo, hi = np.sort(scores, 1)[:, -30].astype(float), scores.max(1).astype(float)
    query, reached = hard_negatives.reached(root, anchors, lo, hi)
    visited = set(zip(query.tolist(), reached.tolist()))
    for q in range(len(anchors)):
        needed = set(leaf[(scores[q] >= lo[q]) & (scores[q] <= hi[q])].tolist())
        assert all((q, k) in visited for k in needed)
    assert len(visited) < 0.5 * len(anchors) * count


def test_scores_that_do_not_fit_raise():
    big = np.full((1, 4), 1 << 40, np.int64)
    with pytest.raises(ValueError, match="63 bits"):
        hard_negatives.products(big, big)
    a = np.array([[(1 << 29) + 1, 3]], np.int64)
    assert hard_negatives.products(a, a)[0, 0] == ((1 << 29) + 1) ** 2 + 9


# --- the registered queries

@pytest.mark.parametrize("name", ["op11_conversations", "op13_hard_negatives"])
def test_query(spark, name):
    oracle.assert_equal(queries.QUERIES[name](spark, SMALL), oracle.connect(SMALL), ORACLE_SQL[name])
