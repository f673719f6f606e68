"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from utterflow.llm import components, decontaminate, frames, host_rules, importance, kernels, language, mixing, near_dedup, queries, substring_dedup, tokens, toxicity, warc

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
DOCS_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def prose(rnd, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()):
    return " ".join(rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(n))


def hard_rows(seed=5):
    """Originals, exact and near copies, blanks, nulls, short and very long texts, shared passages."""
    rnd = random.Random(seed)
    base = [prose(rnd, rnd.randint(30, 120)) for _ in range(30)]
    texts = list(base)
    for k in range(40):
        w = rnd.choice(base).split()
        for _ in range(k % 5):
            w[rnd.randrange(len(w))] = "x" + str(rnd.randint(0, 999))
        texts.append(" ".join(w))
    passage = prose(rnd, 80)
    texts += [f"{prose(rnd, 40)} {passage} {prose(rnd, 40)}" for _ in range(4)]
    texts += ["", None, "  \n\t", "one two", "One  TWO", "Été déjà vu", "ÉTÉ déjà vu", prose(rnd, 20_000), "a" * 50_000, "same " * 300, "#*$%&|<> " * 20]
    return [(i, t, "enfr"[i % 2 * 2 :][:2] if i % 7 else None, f"src{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return frames.saved(spark.createDataFrame(hard_rows(), DOCS).withColumns({"n_words": F.lit("clash"), "band": F.lit(1), "id": F.lit(0), "size": F.lit("x"), "component": F.lit(2), "_id": F.lit(3)}))


def empty(docs):
    return docs.limit(0)


def sets_of(rows):
    out = {}
    for i, t, *_ in rows:
        w = WORD.findall(lower(t))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def grouped(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


# --- 2

def test_superminhash_estimates_jaccard():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 2**63, 400).astype(np.uint64)
    pairs = [(np.sort(a[:300]), np.sort(a[k : 300 + k])) for k in (0, 20, 50, 100)]
    for x, y in pairs:
        s = kernels.superminhash(np.concatenate((x, y)), np.array([0, 300, 600]), 512)
        assert abs((s[0] == s[1]).mean() - len(np.intersect1d(x, y)) / len(np.union1d(x, y))) < 0.08
    assert (kernels.superminhash(a[:1], np.array([0, 1]), 16) >> np.uint64(32)).max() == 15  # one element visits all places


def test_near_duplicates(spark, docs):
    rows = hard_rows()
    sets, want = sets_of(rows), grouped(sets_of(rows), 85)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert near_dedup.near_duplicates(empty(docs)).count() == 0


def test_near_duplicates_repeated_and_null_ids(spark):
    t = prose(random.Random(2), 40)
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (None, None)], "doc_id bigint, text string")
    got = near_dedup.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2


def edited(rnd, base, most, n, first=0):
    """``n`` rows, each ``base`` with up to ``most`` words changed."""
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, most)):
            w[rnd.randrange(len(w))] = f"y{rnd.randint(0, 9999)}"
        rows.append((first + i, " ".join(w)))
    return rows


def test_all_links_of_large_groups(spark):
    """Groups of near copies around the limit: chains, members that no hub reaches, and links between such members."""
    rnd = random.Random(3)
    rows = [r for g in range(4) for r in edited(rnd, prose(rnd, 60).split(), 3 + g, 150, 1000 * g)]
    half = prose(rnd, 50)  # shared by texts that are no copies of each other
    rows += [(9000 + i, f"{half} {prose(rnd, 50)}") for i in range(60)]
    want = grouped(sets_of(rows), 85)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want and len(set(want.values())) > 70


def test_links_without_help_of_bands(spark):
    """All members share one band, so each pair must be linked, compared or ruled out."""
    rnd = random.Random(31)
    rows = [r for g in range(3) for r in edited(rnd, prose(rnd, 40).split(), 6, 40, 100 * g)]
    sets, want = sets_of(rows), grouped(sets_of(rows), 80)
    number = {x: k for k, x in enumerate(sorted(set().union(*sets.values())))}
    table = spark.createDataFrame([(i, len(x), [number[e] for e in x]) for i, x in sets.items()], "id bigint, n bigint, set array<bigint>")
    company = spark.createDataFrame([(1, i, 0) for i in sets], "band bigint, id bigint, center bigint")
    got = {r.id: r.component for r in components.linked_components(company, lambda ids: table.join(ids, "id", "left_semi"), 80).collect()}
    assert {i: got.get(i, i) for i in sets} == want and len(set(want.values())) > 10


def test_components_of_chains(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(100, 200), (200, 100), (7, 7)]
    rnd.shuffle(edges)
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: i // 20 * 20 for i in range(60)} | {100: 100, 200: 100}


# --- 1

def test_substring_spans_cover_shared_passages(spark, docs):
    rows = {r[0]: r[1] for r in hard_rows()}
    spans = substring_dedup.repeated_spans(docs).collect()
    words = {i: WORD.findall(lower(t)) for i, t in rows.items()}
    first, later = {}, set()
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            w = tuple(words[i][k : k + 50])
            if first.setdefault(w, i) != i:
                later.add(i)
    assert later <= {s.doc_id for s in spans}
    for s in spans:
        piece = rows[s.doc_id].encode()[s.first_byte : s.end_byte].decode()
        assert len(WORD.findall(piece)) == s.n_words >= 20
        assert WORD.findall(lower(piece)) == words[s.doc_id][s.first_word : s.first_word + s.n_words]
    clean = {i for i in range(30)} & {s.doc_id for s in spans}
    assert not clean  # the first of each group stays whole
    cut = {r.doc_id: r.text for r in substring_dedup.remove_spans(docs, substring_dedup.repeated_spans(docs)).collect()}
    assert set(cut) == set(rows) and cut[0] == rows[0] and all(len(cut[s.doc_id]) < len(rows[s.doc_id]) for s in spans)
    assert substring_dedup.repeated_spans(empty(docs)).count() == 0


def test_paragraph_cuts_depend_on_the_passage():
    rnd = random.Random(6)
    passage = prose(rnd, 480)

    def cuts(text):
        data = text.encode()
        h, b, *_ = kernels.word_table(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        return substring_dedup.paragraph_starts(h, b)[0].tolist()

    a, b = cuts(f"{prose(rnd, 33)} {passage}"), cuts(f"{prose(rnd, 71)} {passage}")
    inner = lambda c, k: [x - k for x in c if k + 32 <= x < k + 448]
    assert inner(a, 33) == inner(b, 71) and len(inner(a, 33)) > 2


def plain_spans(rows, percent=80, min_words=20, seed=10, reach=10, gap=6):
    """Removable (first word, words, kept ids) by id, by the stated rules, with nothing but loops over words."""
    words, cuts = {}, {}
    for i, t in rows:
        data = (t or "").encode()
        h, b, *_ = kernels.word_table(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        words[i] = [int(x) for x in h]
        cuts[i] = [*substring_dedup.paragraph_starts(h, b)[0].tolist(), len(h)] if len(h) else [0]
    rank = lambda w: int(kernels.window_hashes(np.array(w, np.uint64), len(w))[0])
    first, seeds = {}, {}
    for i in sorted(words):
        h = [rank(words[i][k : k + seed]) for k in range(len(words[i]) - seed + 1)]
        seeds[i] = sorted({min(range(k, k + reach + 1), key=lambda x: (h[x], x)) for k in range(len(h) - reach)})
        for k in seeds[i]:
            first.setdefault(tuple(words[i][k : k + seed]), (i, k))
    parts = []
    for i in words:
        lines = collections.defaultdict(list)
        for k in seeds[i]:
            d, p = first[tuple(words[i][k : k + seed])]
            if d != i or k >= p + seed:
                lines[d, k - p].append(k)
        runs = collections.defaultdict(list)
        for (d, shift), at in lines.items():
            start = at[0]
            for k, after in zip(at, [*at[1:], 10**9]):
                if after - k > seed:
                    a, b, stop = start, k + seed, k + seed
                    while start - a < reach and a and a - shift and words[i][a - 1] == words[d][a - shift - 1]:
                        a -= 1
                    while b - stop < reach and b < len(words[i]) and b - shift < len(words[d]) and words[i][b] == words[d][b - shift]:
                        b += 1
                    runs[d].append((a, b, a - shift))
                    start = after
        for d, found in runs.items():
            parts += [(i, a, b, d) for a, b, _ in found]
            found.sort()
            parts += [(i, b, c, d) for (a, b, p), (c, _, q) in zip(found, found[1:]) if 1 <= c - b <= gap and 0 <= q - (p + b - a) <= gap]
    pars = [(i, a, b, frozenset(tuple(words[i][k : k + 5]) for k in range(a, max(a + 1, b - 4))) if b - a >= 5 else frozenset([tuple(words[i][a:b])])) for i in words for a, b in zip(cuts[i], cuts[i][1:]) if b - a >= seed]
    ids = {x: sorted(k for k, p in enumerate(pars) if p[3] == x) for x in {p[3] for p in pars}}
    group = grouped(dict(enumerate(ids)), percent)
    together = collections.defaultdict(list)
    for k, x in enumerate(ids):
        together[group[k]].append(x)
    for classes in together.values():
        members = sorted(pars[k][:3] for x in classes for k in ids[x])
        parts += [(*m, members[0][0]) for m in members[1:]]
    out = []
    for i, a, b, d in sorted(parts):
        if out and out[-1][0] == i and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
            out[-1][3].add(d)
        else:
            out.append([i, a, b, {d}])
    return sorted((i, a, b - a, sorted(d)) for i, a, b, d in out if b - a >= min_words)


def test_substring_spans_equal_plain_rules(spark, docs):
    rows = [(i, t) for i, t, *_ in hard_rows() if len(t or "") < 100_000]
    rnd = random.Random(23)
    long_ = prose(rnd, 300).split()
    rows += edited(rnd, long_, 8, 12, 200) + [(300, "over and " * 50), (301, "same " * 300), (302, " ".join(long_[100:180] * 3)), (303, " ".join(long_[:16]))]
    got = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = plain_spans(rows)
    assert sorted((r.doc_id, r.first_word, r.n_words, r.kept_doc_ids) for r in got) == want and len(want) > 30
    assert any(r.n_paragraphs for r in got)
    # ids that don't tell rows apart, or are no numbers, give the same spans
    names = [(f"d{i:04}" if i != 31 else None, t) for i, t in rows] + [("d0000", rows[0][1])]
    got = substring_dedup.repeated_spans(spark.createDataFrame(names, "doc_id string, text string")).collect()
    order = sorted(range(len(names)), key=lambda k: (names[k][0] is None, names[k][0], k))
    want = plain_spans([(n, names[k][1]) for n, k in enumerate(order)])
    shown = sorted((names[order[i]][0] or "", a, n, sorted({names[order[d]][0] or "" for d in of})) for i, a, n, of in want)
    assert sorted((r.doc_id or "", r.first_word, r.n_words, sorted({k or "" for k in r.kept_doc_ids})) for r in got) == shown


def test_substring_recall_of_edited_passages(spark):
    """Share of the words of 100-word passages with edits that spans hold."""
    for edits, least in ((0, 1.0), (1, 0.95), (2, 0.9)):
        rnd, rows, place = random.Random(edits), [], {}
        for k in range(100):
            p = prose(rnd, 100).split()
            rows.append((k, " ".join([prose(rnd, rnd.randint(10, 90)), *p, prose(rnd, 30)])))
            before = rnd.randint(10, 90)
            for e in rnd.sample(range(100), edits):
                p[e] = f"changed{e}"
            rows.append((1000 + k, " ".join([prose(rnd, before), *p, prose(rnd, 30)])))
            place[1000 + k] = set(range(before, before + 100))
        found = collections.defaultdict(set)
        for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
            found[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
        assert set(found) == set(place)
        assert sum(len(found[i] & place[i]) for i in place) >= least * 100 * len(place)


def earlier_windows(rows, width=20):
    """Words, by id, in a window of ``width`` words that an earlier place has; a window over its own first occurrence doesn't count."""
    first, out = {}, collections.defaultdict(set)
    for i, t in sorted(rows):
        w = WORD.findall(lower(t))
        for k in range(len(w) - width + 1):
            d, p = first.setdefault(tuple(w[k : k + width]), (i, k))
            if d != i or k >= p + width:
                out[i] |= set(range(k, k + width))
    return out


def test_substring_spans_hold_all_repeated_words(spark, docs):
    """Exact passages of 51 to 60 words inside two documents go whole, edited ones all but the words beside the edit."""
    rnd = random.Random(21)
    rows, cut, edit = [], {}, {}
    for k in range(300):
        n, at = rnd.randint(51, 60), rnd.randrange(60)
        p = prose(rnd, n if k % 3 else 60).split()
        a, b = prose(rnd, rnd.randint(10, 90)).split(), prose(rnd, rnd.randint(10, 90)).split()
        rows.append((k, " ".join([*a, *p, *prose(rnd, 30).split()])))
        q = [*p[:at], "changed", *p[at + 1 :]] if k % 3 == 0 else p
        rows.append((1000 + k, " ".join([*b, *q, *prose(rnd, 30).split()])))
        (cut if k % 3 else edit)[1000 + k] = (len(b), len(b) + len(q), len(b) + at)
    rows += [(5000, "over and " * 50), (5001, "a b c d e f g h i j k l m n o p q r s t " * 3)]
    spans = collections.defaultdict(set)
    for s in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        spans[s.doc_id] |= set(range(s.first_word, s.first_word + s.n_words))
        assert s.kept_doc_ids and s.n_words >= 20
    assert all(set(range(a, b)) <= spans[i] for i, (a, b, _) in cut.items())
    assert all(spans[i] & set(range(a, b)) for i, (a, b, _) in edit.items())
    want = earlier_windows(rows)
    assert all(w <= spans[i] for i, w in want.items())
    assert not {i for i in spans if i < 1000}
    want = earlier_windows([(r[0], r[1]) for r in hard_rows()])
    spans = collections.defaultdict(set)
    for s in substring_dedup.repeated_spans(docs).collect():
        spans[s.doc_id] |= set(range(s.first_word, s.first_word + s.n_words))
    assert all(w <= spans[i] for i, w in want.items())


# --- 3

def test_importance(spark, docs):
    target = docs.where("doc_id % 2 = 0 and doc_id < 30")
    out = importance.importance_resample(docs, target, 0.5).collect()
    assert len(out) == len(hard_rows()) and sum(r.selected for r in out) == round(0.5 * len(out))
    low = min(r.gumbel_key for r in out if r.selected)
    assert all(r.gumbel_key <= low for r in out if not r.selected)
    raw, good = np.ones(importance.BUCKETS), np.ones(importance.BUCKETS)
    buckets = {}
    for i, t, *_ in hard_rows():
        data = (t or "").encode()
        buckets[i] = importance.gram_buckets(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[1]
        np.add.at(raw, buckets[i], 1)
        if i % 2 == 0 and i < 30:
            np.add.at(good, buckets[i], 1)
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    for r in out:
        assert r.n_grams == len(buckets[r.doc_id]) and r.log_weight == pytest.approx(ratio[buckets[r.doc_id]].sum(), abs=1e-6)
    assert importance.importance_resample(empty(docs), target, 0.5).count() == 0
    assert importance.importance_resample(docs, empty(docs), 1.0).where("selected").count() == len(out)


def test_kth_greatest(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice([0.5, rnd.random()]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "v double, i bigint")
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    for k in (1, 37, 250, 500):
        assert importance.kth_greatest(df, "v", "i", k, small=20) == order[k - 1]
    assert importance.kth_greatest(df, "v", "i", 501) is None
    # neighbouring floats, whose mean is one of them
    for v in (1.0, float(np.nextafter(1.0, 2)), -3.5):
        near = spark.createDataFrame([(v, i) for i in range(600)] + [(float(np.nextafter(v, 9)), i) for i in range(5)], "v double, i bigint")
        assert importance.kth_greatest(near, "v", "i", 3, small=20) == (float(np.nextafter(v, 9)), 2)
        assert importance.kth_greatest(near, "v", "i", 6, small=20) == (v, 0)


# --- 4

def test_toxicity_held_out(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(900):
        bad = i % 4 == 0
        w = prose(rnd, 60).split()
        for _ in range(2 * bad):
            w[rnd.randrange(60)] = rnd.choice(["vileword", "nastyword"])
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    w = toxicity.fit_toxicity(df, df.where(~held))
    assert len(w[0]) < 2000
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, w).collect()}
    out = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == rows[i][2] for i in out) / len(out) > 0.95
    odd = toxicity.score_toxicity(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string"), w).collect()
    assert len({r.score for r in odd}) == 1 and 0 <= odd[0].score <= 1
    none = toxicity.fit_toxicity(df, df.limit(0))
    assert toxicity.score_toxicity(df.limit(3), none).select("score").distinct().first()[0] == 0.5


def plain_ftrl(rows, l1):
    """Weights after the passes over (features, label), with dictionaries of features; order as in the fit."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    weight = lambda f: 0.0 if abs(z[f]) <= l1 else -(z[f] - np.sign(z[f]) * l1) / ((toxicity.BETA + n[f] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    for _ in range(toxicity.EPOCHS):
        for features, y in rows:
            w = {f: weight(f) for f in features}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for f in features:
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / toxicity.ALPHA * w[f]
                n[f] += g * g
    return {f: weight(f) for f in z if weight(f)}


def test_toxicity_equals_plain_ftrl(spark):
    """Weights of a small fit, repeated ids, null and conflicting labels and clashing columns included."""
    rnd = random.Random(18)
    rows = [(i, prose(rnd, 12) + (" vileword" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(16)]
    rows += [(20, None, 1), (21, "", 0), (22, "no label", None), (3, "another text of one id", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").withColumns({"_order": F.lit("clash"), "_label": F.lit(3), "at": F.lit(1)})
    labels = df.select("doc_id", "toxic").unionByName(spark.createDataFrame([(5, 1), (5, 0)], "doc_id bigint, toxic int"))
    at, w = toxicity.fit_toxicity(df, labels)
    order = {r.i: r.o for r in df.select(F.col("doc_id").alias("i"), F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 40)).alias("o")).collect()}
    pairs = {(r.doc_id, r.toxic) for r in labels.collect() if r.toxic is not None}
    sample = []
    for i, t, _ in rows:
        for y in (0, 1):
            if (i, y) in pairs:
                data = (t or "").encode()
                x = np.append(toxicity.hashed_features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[1], toxicity.DIMENSIONS)
                sample.append((order[i], y, len(x), x.astype(np.int32).tobytes(), x.tolist()))
    sample = sorted(sample)
    inner, outer = [(x[4], x[1]) for x in sample if x[0] % toxicity.FOLDS], [(x[4], x[1]) for x in sample if not x[0] % toxicity.FOLDS]
    losses = []
    for l1 in toxicity.L1S:
        v = plain_ftrl(inner, l1)
        losses.append(sum(np.log1p(np.exp(-(1 if y else -1) * sum(v.get(f, 0) for f in x))) for x, y in outer))
    assert outer and max(losses) > min(losses)
    want = plain_ftrl([(x[4], x[1]) for x in sample], toxicity.L1S[int(np.argmin(losses))])
    assert dict(zip(at.tolist(), w)) == pytest.approx(want) and len(want) > 5
    got = toxicity.score_toxicity(df, (at, w)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


# --- 5

def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    rnd = random.Random(10)
    pieces = ["<|endoftext|>", "'s", " 're", "  ", "\n\n", "don't", "é", "語", "٣", "😀", "aaaa", "!?", "1234", "　", "\x1c", " ", "Word", "'ll", "<|end", "of"]
    odd = ["".join(rnd.choices(pieces, k=rnd.randint(0, 25))) for _ in range(400)] + [None, "", "a" * 3000, " " * 500]
    odd += ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (255, 256, 257, 5_000)] + ["".join(rnd.choices(x, k=2_000)) for x in ("ab", "aaab", "é語a")] + ["a" * 257]
    texts = odd + [r[1] for r in hard_rows()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = sorted(tokens.token_counts(df, public_tokenizers.path("byte_bpe_50k.json")).collect())
    assert [r.n_tokens for r in got] == want
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts] and [r.over_limit for r in got] == [n > 512 for n in want]
    assert tokens.token_counts(empty(docs), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_long_words_take_seconds():
    import time

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = tokens.Vocabulary(f.read())
    data = np.frombuffer("".join(random.Random(17).choices("etaoinshrdlu", k=400_000)).encode(), np.uint8)
    start = time.perf_counter()
    assert 0 < vocabulary.count(data, np.array([0]), np.array([len(data)]))[0] < 400_000
    assert time.perf_counter() - start < 30


# --- 6

def measures(t):
    w = WORD.findall(t or "")
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_host_rules(spark, docs):
    rows = hard_rows()
    got = {r.doc_id: r for r in host_rules.host_quality(docs).collect()}
    hosts = collections.defaultdict(list)
    for i, t, _, s, _ in rows:
        m = measures(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == m
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        assert got[i].base_failed == failed
        hosts[s].append((i, failed))
    share = {s: sum(f for _, f in v) / len(v) for s, v in hosts.items()}
    mean, var = np.mean(list(share.values())), np.var(list(share.values()))
    k = max(mean * (1 - mean) / var - 1, 0)
    for s, v in hosts.items():
        rate = (share[s] * len(v) + mean * k) / (len(v) + k)
        assert all(got[i].kept == (not f and not rate > 0.5) and got[i].host_failure_rate == pytest.approx(rate, abs=1e-8) for i, f in v)
    assert host_rules.host_quality(empty(docs)).count() == 0
    assert host_rules.host_quality(docs.where("doc_id = 3")).count() == 1


# --- 7

def test_warc_round_trip(spark):
    same = "s" * 1500
    rows = [(1, "http://a/ b", same), (2, None, same), (5, "http://c", same), (3, "", "short"), (4, "u", "short"), (6, "é", None), (7, "x", "é\r\n\r\n" * 400), (None, "n", "null id")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    got = {r.page_id: r for r in warc.archive_round_trip(df).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = i in (1, 2)
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 5) if revisit else ("response", None))
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    # null ids revisit the greatest id of their payload; without any id, all are responses
    odd = spark.createDataFrame([(None, "u", same), (None, "v", same), (7, "w", same), (None, "x", "n" * 1200), (None, "y", "n" * 1200)], "page_id bigint, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(odd).collect()), key=repr)
    assert got == sorted([(7, 1500, "response", None)] + [(None, 1500, "revisit", 7)] * 2 + [(None, 1200, "response", None)] * 2, key=repr)


def test_warc_files_are_plain_zstandard(spark, tmp_path):
    import glob
    import io

    import zstandard

    df = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 50) for i in range(200)], "page_id bigint, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"))
    records = b""
    for f in glob.glob(f"{tmp_path}/w/part-*"):
        data = open(f, "rb").read()
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
        size = int.from_bytes(data[4:8], "little")
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        records += d.stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert records.count(b"WARC/1.1\r\n") == 200


def test_warc_ids_and_archives(spark, tmp_path, monkeypatch):
    """String ids of any characters come back, equal ids and null ids are no hot archive, and a task writes several archives."""
    monkeypatch.setattr(warc, "RUN_BYTES", 2_000)
    rnd = random.Random(16)
    same = "s" * 2000
    rows = [("null", "u", "x"), ("d\r\nX: 1", "http://a/é b%20", "y"), (None, None, "z"), ("<%>", "u", same), ("b", "u", same), ("b", "u", same)]
    rows += [("hot" if k % 2 else None, f"u{k}", "".join(rnd.choices("abcdefgh ", k=1500))) for k in range(400)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").withColumns({"id": F.lit(1), "payload": F.lit("clash"), "size": F.lit(2)}).repartition(2)
    got = sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect()), key=repr)
    want = [(i, hashlib.sha1(t.encode()).hexdigest(), "revisit" if i == "<%>" else "response", "b" if i == "<%>" else None) for i, _, t in rows]
    assert got == sorted(want, key=repr)
    warc.write_archives(df, str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("part-*"))) > 4


def test_warc_rejects_damage():
    raw = warc.record_bytes(1, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None)
    assert warc.parse_record(raw)[:3] == ("1", "response", 5)
    for bad in (raw[:-1], raw.replace(b"hello", b"hellO"), raw.replace(b"Content-Length: 5", b"Content-Length: 6"), raw.replace(b"WARC/1.1", b"WORC/1.1"), raw.replace(b"WARC-Type", b"X-Type")):
        with pytest.raises(warc.BadArchive):
            warc.parse_record(bad)
    import zstandard

    frame = zstandard.ZstdCompressor(write_checksum=True).compress(raw * 300)
    assert warc.frame_end(frame + b"rest", 0) == len(frame)
    for cut in (3, 7, len(frame) - 1):
        with pytest.raises(warc.BadArchive):
            list(warc.read_frames(frame[:cut]))


# --- 8

def test_language(spark):
    rnd = random.Random(11)
    syllables = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "keit", "ver"], "cc": ["eau", "ment", "tion", "oi"]}
    rows = [(i, " ".join("".join(rnd.choices(syllables[g], k=3)) for _ in range(25)), g) for i in range(240) for g in [list(syllables)[i % 3]]]
    rows += [(900, None, "aa"), (901, "12 !? ", "bb"), (902, "Ωω", None), (903, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    f = language.fit_language_filters(df, ~held)
    got = {r.doc_id: r for r in language.identify_languages(df, f).collect()}
    assert all(got[i].lang_pred == g for i, _, g in rows[:240])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 903)) and got[902].lang_pred in syllables
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language.fit_language_filters(df.limit(0), ~held)
    assert {r.lang_pred for r in language.identify_languages(df, nothing).collect()} == {"und"}


def plain_language(rows, train):
    """Prediction and score of each text from sets of n-grams, without a Bloom filter."""
    fold = lambda t: re.sub(r"[\x00-\x60\x7b-\x7f]+", " ", f" {t.lower()} ").encode()
    cut = lambda f: [f[k : k + n] for n in language.SIZES for k in range(len(f) - n + 1)]
    known, n = collections.defaultdict(set), collections.Counter()
    for i, t, g in rows:
        if g is not None and train(i):
            n[g] += 1
            known[g] |= set(cut(fold(t or "")))
    order = sorted(n, key=lambda g: (-n[g], g))
    out = {}
    for i, t, _ in rows:
        if not any(map(str.isalpha, t or "")):
            out[i] = ("und", 0.0)
            continue
        own = cut(fold(t))
        c = {g: sum(x in known[g] for x in own) for g in order}
        best = max(order, key=lambda g: (c[g], -order.index(g)))
        out[i] = (best, c[best] / sum(c.values()) if sum(c.values()) else 1 / len(order))
    return out


def test_language_equals_plain_sets(spark):
    rnd = random.Random(12)
    parts = {f"l{k:02}": ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzéß", k=3)) for _ in range(6)] for k in range(70)}
    rows = [(i, " ".join("".join(rnd.choices(parts[g], k=2)) for _ in range(20)) + rnd.choice(["", " ÉTÉ 12", "\n!? Ü"]), g) for i in range(420) for g in [list(parts)[i % 70]]]
    rows += [(7000, None, "l01"), (7001, "... 12", "l02"), (7002, "qq", None), (7002, rows[0][1], None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"language": F.lit(1), "order": F.lit("clash")})
    train = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    f = language.fit_language_filters(df, train)
    want = plain_language(rows, lambda i: zlib.crc32(str(i).encode()) % 3 != 1)
    got = language.identify_languages(df.where("doc_id <> 7002"), f).collect()
    assert len(f.languages) == 70 and f.table.shape[1] == 2
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=0.02)


def test_language_learns_rows_under_their_own_lang(spark):
    """A row without a language, or one of another language, that repeats a sampled id is not learned under that id's language."""
    df = spark.createDataFrame([(1, "kato miru kato", "aa"), (1, "zzzz qqqq", None), (1, "vvvv wwww", "bb"), (None, "xoxo", "aa")], "doc_id bigint, text string, lang string")
    f = language.fit_language_filters(df, F.lit(True))
    data = b" zzzz qqqq  vvvv wwww  xoxo "
    counts = f.counts(np.frombuffer(data, np.uint8), np.array([0, 11, 22, 28]))
    assert counts[0].max() < 0.1 and counts[1][f.languages.index("bb")] > 5 > counts[1][f.languages.index("aa")] and counts[2][f.languages.index("aa")] > 3


def test_filter_false_positives():
    rnd = np.random.default_rng(2)
    packed = rnd.integers(0, 1 << 40, 150_000).astype(np.uint64)
    f = language.Filters.of_grams({"a": packed, "b": packed[:10]})
    assert ((f.masks(packed, 0) & np.uint64(1)) == 1).all()
    other = rnd.integers(1 << 41, 1 << 42, 400_000).astype(np.uint64)
    share = ((f.masks(other, 0) & np.uint64(1)) == 1).mean()
    assert share == pytest.approx(f.false[0], rel=0.1)


# --- 9

def test_mix(spark, docs):
    got = {r.doc_id: r for r in mixing.mix(docs, rows_per_range=4).collect()}
    rows = hard_rows()
    plain = plain_mix([(i, t, s) for i, t, _, s, _ in rows])
    assert {i: r.taken for i, r in got.items()} == {i: p[3] for i, p in plain.items()}
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    by = collections.defaultdict(list)
    for i, _, _, s, _ in rows:
        by[s].append(i)
    order = sorted((s for s in by if s is not None)) + [None]
    total, sizes = sum(size.values()), {s: sum(size[i] for i in by[s]) for s in by}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    fixed = {}
    while True:
        rest = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * level > 3 * sizes[s]]
        if not over:
            break
        fixed |= {s: 3 * sizes[s] for s in over}
    target = {s: fixed.get(s, weight[s] * level) for s in order}
    for s, ids in by.items():
        assert sum(got[i].taken for i in ids) == int(target[s]) or abs(sum(got[i].taken for i in ids) - target[s]) < 1
        assert all(got[i].size == size[i] and got[i].source_size == sizes[s] and got[i].target == pytest.approx(target[s]) and 0 <= got[i].taken <= 3 * size[i] for i in ids)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7), rows_per_range=4).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    assert mixing.mix(empty(docs)).count() == 0


def test_mix_folds_equal_rows(spark, monkeypatch):
    """A hot id, and a null id, with very many equal rows: sums stay exact and no row is lost."""
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(None, "one two three", "s0")] * 100 + [(5, "a b", "s1")] * 50 + [(k, prose(random.Random(k), 20), "s2") for k in range(30)] + [(None, None, None)] * 20
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"_n": F.lit(1), "taken": F.lit("clash")})
    got = mixing.mix(df, rows_per_range=4).collect()
    sizes = {300: "s0", 100: "s1", 600: "s2", 0: None}
    assert len(got) == 200 and collections.Counter(sizes[r.source_size] for r in got) == {"s0": 100, "s1": 50, "s2": 30, None: 20}
    for source in sizes.values():
        own = [r for r in got if sizes[r.source_size] == source]
        assert sum(r.taken for r in own) == int(own[0].target) and all(0 <= r.taken <= 3 * r["size"] for r in own)


# --- 10

def hits(text, items, window=10):
    w = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for i, t in items:
        x = ALNUM.findall(lower(t))
        n = min(window, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_contamination(spark):
    rnd = random.Random(12)
    items = [(i, prose(rnd, rnd.choice([3, 9, 10, 11, 25]))) for i in range(12)] + [(20, None), (21, " ,"), (22, "the the the the the the the the the the the the"), (23, "x y"), (24, "x y")]
    rows = [(i, prose(rnd, 60), "c") for i in range(20)]
    for i in range(20, 60):
        w, x = prose(rnd, 40).split(), rnd.choice(items[:12])[1].split()
        a = rnd.randrange(len(x))
        w[i % 40 : i % 40] = x[a // 2 :]
        rows.append((i, ", ".join(w).upper() if i % 2 else " ".join(w), "c"))
    rows += [(100, None, "c"), (101, "", "c"), (102, "the " * 40, "c"), (103, "X-Y é x y", "c"), (104, " ".join(t for _, t in items if t) * 3, "c"), (104, "nothing here", "c"), (None, items[0][1], "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, item string")
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    got = decontaminate.contamination(df, bench).collect()
    want = [(i, *hits(t, items)) for i, t, _ in rows]
    shown = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got]
    assert sorted(shown, key=repr) == sorted(((i, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0) for i, n, h, f in want), key=repr)
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0


def plain_proximity(rows, items, n_terms=3, span=20):
    at, n = collections.defaultdict(lambda: collections.defaultdict(set)), collections.Counter()
    for i, t in rows:
        for p, w in enumerate(ALNUM.findall(lower(t))):
            at[i][w].add(p)
    for of in at.values():
        n.update({w: len(p) for w, p in of.items()})
    out = {}
    for j, t in items:
        rare = sorted(set(ALNUM.findall(lower(t))), key=lambda w: (n[w], w))[:n_terms]
        if rare and all(n[w] for w in ALNUM.findall(lower(t))):
            for i in at:
                places = [p for p in at[i][rare[0]] if all(any(abs(q - p) < span for q in at[i][w]) for w in rare[1:])]
                if places:
                    out[i, j] = (min(places), len(places))
    return out


def test_proximity(spark):
    rnd = random.Random(15)
    items = [(j, prose(rnd, rnd.choice([1, 2, 6, 12]))) for j in range(10)] + [(50, None), (51, "neverseen alpha1"), (52, "q rare0 rare1")]
    rows = [(i, prose(rnd, 80)) for i in range(20)] + [(100, None), (101, "rare1 " + "w " * 17 + "rare0 q"), (102, "rare1 " + "w " * 18 + "rare0 q")]
    for i in range(20, 60):
        w, x = prose(rnd, 60).split(), rnd.choice(items[:10])[1].split()
        for term in rnd.sample(x, len(x)):
            w.insert(rnd.randrange(30), term)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"item": F.lit(1), "part": F.lit("clash")})
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id): (r.first_pos, r.n_places) for r in decontaminate.proximity_matches(df, bench).collect()}
    assert got == plain_proximity(rows, items) and len(got) > 10 and (101, 52) in got and (102, 52) not in got
    assert decontaminate.proximity_matches(df.limit(0), bench).count() == decontaminate.proximity_matches(df, bench.limit(0)).count() == 0


# --- queries and pipeline

@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SMALL)
    if name in queries.ORACLE_SQL:
        oracle.assert_equal(df, con, queries.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def plain_quality(rows):
    """Ids that the quality rules keep, of (id, text, source)."""
    hosts, failed = collections.defaultdict(list), {}
    for i, t, s in rows:
        m = measures(t)
        failed[i] = m[0] < 50 or 100 * m[4] > 50 * m[0]
        hosts[s].append(failed[i])
    share = [sum(f) / len(f) for f in hosts.values()]
    mean, var = np.mean(share), np.var(share)
    k = max(mean * (1 - mean) / var - 1, 0) if var > 1e-12 else np.mean([len(f) for f in hosts.values()])
    bad = {s for s, f in hosts.items() if (sum(f) + mean * k) / (len(f) + k) > 0.5}
    return {i for i, _, s in rows if not failed[i] and s not in bad}


def plain_cut(rows):
    """Texts, by id, of (id, text) without the repeated spans; those left without a word go."""
    spans, out = collections.defaultdict(list), {}
    for i, a, n, _ in plain_spans(rows):
        spans[i].append((a, a + n))
    for i, t in rows:
        at, keep, done = [(m.start(), m.end()) for m in WORD.finditer(t)], [], 0
        for a, b in sorted(spans[i]):
            keep.append(t[done : at[a][0]])
            done = at[b - 1][1]
        text = "".join([*keep, t[done:]])
        if WORD.search(text):
            out[i] = text
    return out


def plain_mix(rows):
    """(size, source_size, target, taken) by id of (id, text, source)."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    by = collections.defaultdict(list)
    for i, _, s in rows:
        by[s].append(i)
    order = sorted((s for s in by if s is not None)) + [None] * (None in by)
    total, sizes = sum(size.values()), {s: sum(size[i] for i in by[s]) for s in by}
    weight, fixed = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}
    while True:
        rest = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if weight[s] * level > 3 * sizes[s]]
        if not over:
            break
        fixed |= {s: 3 * sizes[s] for s in over}
    out = {}
    for s in order:
        target, place = fixed.get(s, weight[s] * level), 0
        epochs, left = divmod(int(target + 1e-6), sizes[s]) if sizes[s] else (0, 0)
        for i in sorted(by[s], key=lambda i: (hashlib.md5(f"{i}|17".encode()).hexdigest(), i)):
            out[i] = (size[i], sizes[s], target, epochs * size[i] + max(0, min(size[i], left - place)))
            place += size[i]
    return out


def test_pipeline_run_equals_plain_version(spark, con):
    """All rows of run(), texts and counts included, against plain definitions of all stages."""
    docs = {r[0]: r for r in con.execute("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()}
    bench = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    kept = plain_quality([(i, r[1], r[3]) for i, r in docs.items()])
    groups = grouped(sets_of([(i, docs[i][1]) for i in sorted(kept)]), 85)
    texts = plain_cut([(i, docs[i][1]) for i in sorted(kept) if groups[i] == i])
    texts = {i: t for i, t in texts.items() if not hits(t, bench)[1]}
    want = {i: (t, docs[i][2], docs[i][3], len(t), *plain) for (i, t), plain in zip(texts.items(), map(plain_mix([(i, t, docs[i][3]) for i, t in texts.items()]).get, texts)) if plain[3] > 0}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == set(want) and len(got) > 20
    for i, (text, lang, source, n_chars, size, source_size, target, taken) in want.items():
        r = got[i]
        assert (r.text, r.lang, r.source, r.n_chars, r["size"], r.source_size, r.taken) == (text, lang, source, n_chars, size, source_size, taken)
        assert r.target == pytest.approx(target)


def test_pipeline_of_empty_and_odd_tables(spark):
    """Clashing columns go through, n_chars may be missing, and nothing gives nothing."""
    rnd = random.Random(24)
    rows = [(i, prose(rnd, 60), "s") for i in range(12)] + [(None, None, None), (12, "", None)]
    names = ("_cut", "_spans", "id", "band", "_row_key", "size", "taken", "target", "key", "num", "n", "_n", "_pid", "idx")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit("clash") for c in names})
    nothing = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs, nothing = frames.saved(stage(spark, docs, SMALL)), frames.saved(stage(spark, nothing, SMALL))
        assert docs.count() == 12 and nothing.count() == 0 and docs.columns[:3] == ["doc_id", "text", "source"], name
    assert {r.doc_id: r.text for r in docs.collect()} == {i: t for i, t, _ in rows[:12]}


def test_pipeline_null_and_repeated_ids(spark):
    """Every row is a document of its own, whatever its id."""
    rnd = random.Random(22)
    a, b, c, d, e, f, g, h, p = (prose(rnd, 60) for _ in range(9))
    rows = [(None, a), (None, b), (7, c), (7, d), (7, d), (8, "too short"), (8, e), (1, f"{f} {p}"), (9, f"{p} {g}"), (9, "éö " + h)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], DOCS)
    want = {"quality_rules": [a, b, c, d, d, e, f"{f} {p}", f"{p} {g}", "éö " + h], "near_dedup": [a, b, c, d, e, f"{f} {p}", f"{p} {g}", "éö " + h]}
    want["substring_dedup"] = want["decontaminate"] = want["mix_sources"] = [a, b, c, d, e, f"{f} {p}", g, "éö " + h]
    ids = {t: i for i, t in rows} | {g: 9}
    for name, stage in corpus_pipeline.STAGES:
        docs = frames.saved(stage(spark, docs, SMALL))
        got = docs.collect()
        assert sorted(r.text.strip() for r in got) == sorted(want[name]), name
        assert all(r.doc_id == ids[r.text.strip()] for r in got) and not set(docs.columns) - set(DOCS_COLUMNS) - {"size", "source_size", "target", "taken"}
    assert all(r.taken == r["size"] == len(r.text.split()) for r in got)


def test_hot_group_of_copies(spark):
    """A third of all rows equal, on many partitions."""
    rnd = random.Random(13)
    same = prose(rnd, 60)
    rows = [(i, same if i % 3 == 0 else prose(rnd, 30), "en", "src0" if i % 3 else "src1", 1) for i in range(600)]
    df = spark.createDataFrame(rows, DOCS).repartition(16)
    got = near_dedup.near_duplicates(df)
    assert got.where("component_id = 0").count() == 200 and got.where("kept").count() == 401
    assert substring_dedup.repeated_spans(df).where("n_words = 60").count() == 199


def test_text_kernel_splits_rows():
    texts = ["a bb", "", None, "ccc", " d\te ", "é\x0bf"]
    for _, _, data, offsets in kernels.chunks(pa.array(texts)):
        s, e, row = kernels.word_spans(data, offsets)
        assert [(int(r), data[a:b].tobytes().decode()) for a, b, r in zip(s, e, row)] == [(0, "a"), (0, "bb"), (3, "ccc"), (4, "d"), (4, "e"), (5, "é"), (5, "f")]
    assert [x[:2] for x in kernels.chunks(pa.array(["x" * 10] * 5), 25)] == [(0, 2), (2, 4), (4, 5)]
