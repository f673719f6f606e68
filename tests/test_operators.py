import collections
import datetime
import hashlib
import io
import json
import math
import os
import random
import tarfile

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

import oracle
from utterflow.functions import keys, signal, text
from utterflow.operators import asr, batching, calls, manifest, ordering, scoring, shards, splits, stats, telemetry, trials, vocab
from utterflow.plans import catalogue
from utterflow.plans.catalogue import QUERIES
from utterflow.plans.oracles import ORACLE_SQL
from utterflow.plans.tasks import BatchConfig, check_sets, compose_sets, gender_batches, joint_batches, speaker_batches, speech_batches
from utterflow.schemas import MANIFEST
from utterflow.sources import storage, tables, tar, wav
from utterflow.streaming import streams


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def samples(spark, n=24, speakers=3):
    rows = [(f"ls/{i % speakers}/{i % 2}/{i:04d}", f"/a/{i}.wav", 100 + 10 * i, 16000, f"ls/{i % speakers}", f"ls/{i % 2}", "mf"[i % speakers % 2], "en", f"word {i}") for i in range(n)]
    return spark.createDataFrame(rows, MANIFEST)


def test_keys(spark):
    assert column(spark, ["ls/1/2/3", "xx/1/2/3", "ls/1/2", "ls//2/3", None, "ls/1/2/3/4"], keys.is_key) == [True, False, False, False, False, False]
    assert column(spark, ["/d/vc2/id1/x/9.wav", "vc1/a/b/c ls/1/2/3", "ls/a-b/c/d", "none"], keys.find_key) == ["vc2/id1/x/9", "ls/1/2/3", None, None]
    assert column(spark, ["ls/12", "vc1/id007", "hub5/ab", None], keys.speaker_number) == [12, 7, None, None]
    assert column(spark, ['"MALE"', "f", "Female", "x", None], keys.gender_code) == ["m", "f", "f", None, None]
    assert column(spark, ["EN_us", "zh-hant-tw", " de "], keys.standard_tag) == ["en-US", "zh-Hant-TW", "de"]


def test_cleaning(spark):
    assert column(spark, ["a  b\t\nc ", "", None], text.single_spaced) == ["a b c", "", None]
    assert column(spark, ["It's 9 O'Clock, é!"], text.english_letters) == ["it's  o'clock "]
    assert column(spark, ["a  b", "uh-huh yes, sir", "duh", "3e"], text.clean_call) == ["a  b", "yes sir", "d", "e"]
    assert column(spark, ["duh uh no"], lambda c: text.clean_call(c, whole_words=True)) == ["duh no"]
    assert column(spark, ["**&x** Hi {breath} [[laughing]] [dist] <spanish > &Bob wor- word %uh ((planes)) ok?"], text.clean_annotations) == ["hi bob word ok"]
    assert column(spark, ["@A.12", "*B.7", "@@**A.1", "***A.1"], text.clean_sentence_id) == ["A.12", "B.7", "A.1", "*A.1"]
    assert column(spark, [7, 1234567], text.padded_id, "int") == ["000007", "1234567"]


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_word_errors(spark):
    rnd = random.Random(4)
    pairs = [("the cat sat", "the cat sat on"), ("a b c d", "a x c"), ("", "one two"), ("a b", ""), (None, None)]
    pairs += [tuple(" ".join(rnd.choices("abc", k=rnd.randint(0, 8))) for _ in "rh") for _ in range(60)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, ref string, hyp string")
    want = [edit((r or "").split(), (h or "").split()) for r, h in pairs]
    assert [r.errors for r in asr.pair_errors(df).orderBy("i").collect()] == want
    one = asr.wer(df).first()
    assert one.errors == sum(want) and one.wer == pytest.approx(sum(want) / sum(len((r or "").split()) for r, _ in pairs))
    assert asr.wer(df.where("i = 2")).first().wer is None


def test_ctc(spark):
    one_hot = lambda i: [1.0 if k == i else 0.0 for k in range(8)]
    df = spark.createDataFrame([([one_hot(i) for i in (0, 5, 5, 0, 5, 6, 6, 4)], None), ([one_hot(5), one_hot(6)], 1), ([], 0)], "logits array<array<double>>, valid_len int")
    out = asr.ctc_greedy(df, ["<blank>", "<s>", "</s>", "<unk>", "|", "a", "b", "c"]).collect()
    assert [r.indices for r in out] == [[5, 5, 6, 4], [5], []] and [r.text for r in out] == ["aab", "a", ""]


def test_prefix(spark):
    rnd = random.Random(1)
    data = [(rnd.choice("abc") if i % 9 else None, rnd.randint(0, 20), i) for i in range(300)]
    df = spark.createDataFrame(data, "g string, v int, i int").repartition(5)
    got = ordering.prefix(df, [F.desc("v"), F.col("i")], ["v"], by=["g"]).collect()
    for g in (None, "a", "b", "c"):
        rows = sorted((r for r in got if r.g == g), key=lambda r: r.idx)
        assert [r.i for r in rows] == [i for _, i in sorted((-v, i) for h, v, i in data if h == g)]
        assert [r.before_v for r in rows] == [sum(r.v for r in rows[:k]) for k in range(len(rows))]
    assert ordering.prefix(df.limit(0), [F.col("i")], ["v"]).count() == 0


def test_prefix_keeps_ranges_apart(spark):
    df = spark.range(4000).select("id", (F.col("id") % 7).alias("v"), F.lit("a").alias("g")).repartition(3)
    plain = ordering.prefix(df, [F.desc("id")], ranges=16)
    for rows in (plain, ordering.prefix(df, [F.desc("id")], ["v"], ranges=16), ordering.prefix(df, [F.desc("id")], ["v"], by=["g"], ranges=16)):
        assert rows.where(F.col("idx") != 3999 - F.col("id")).count() == 0 and rows.count() == 4000
    summed = ordering.prefix(df, [F.desc("id")], ["v"], ranges=16)
    assert max(r["count"] for r in summed.groupBy(F.spark_partition_id()).count().collect()) < 1000


def roc(y, s):
    best, x0, y0 = None, 0.0, 0.0
    p, q = sum(y), len(y) - sum(y)
    for t in sorted(set(s), reverse=True):
        x1 = sum(1 for a, b in zip(y, s) if b >= t and not a) / q
        y1 = sum(1 for a, b in zip(y, s) if b >= t and a) / p
        if x1 + y1 >= 1:
            k = (1 - x0 - y0) / (x1 + y1 - x0 - y0)
            return x0 + k * (x1 - x0)
        x0, y0 = x1, y1
    return best


def dcf(y, s, p=0.05):
    order = sorted(range(len(y)), key=lambda i: (s[i], i))
    pos, neg, best = 0, 0, (math.inf, None)
    for i in order:
        pos, neg = pos + y[i], neg + 1 - y[i]
        c = pos / sum(y) * p + (1 - neg / (len(y) - sum(y))) * (1 - p)
        if c < best[0]:
            best = (c, s[i])
    return best[0] / min(p, 1 - p), best[1]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_error_rates(spark, seed):
    rnd = random.Random(seed)
    y = [rnd.randint(0, 1) for _ in range(400)]
    s = [float(round(min(1, max(0, rnd.gauss(0.45 + 0.15 * v, 0.2))), 2)) for v in y]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(y, s))], "i int, y int, score double")
    assert scoring.eer(df).first().eer == pytest.approx(roc(y, s), abs=1e-9)
    m = scoring.min_dcf(df, trial_no="i").first()
    assert (m.mdc, m.mdc_threshold) == pytest.approx(dcf(y, s), abs=1e-9)


def test_error_rates_extremes(spark):
    def rate(rows, **k):
        return scoring.eer(spark.createDataFrame(rows, "y int, score double"), **k).first()

    assert rate([(1, 0.9), (1, 0.8), (0, 0.2)]).eer == 0
    assert rate([(0, 0.9), (1, 0.1)]).eer == 1
    assert rate([(0, 0.5), (1, 0.5)]).eer == 0.5
    assert rate([(1, 0.5)]).status == "single_class" and rate([(1, 0.5)], compat=True).eer == 1
    assert rate([(1, 0.5), (0, 1.5)]).status == "bad_scores"
    with pytest.raises(ValueError):
        scoring.min_dcf(spark.createDataFrame([(1, 0.5)], "y int, score double"), c_miss=0.5)


def test_scores(spark):
    emb = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [-1.0, 0.0]), ("z", [0.0, 0.0])], "sample_id string, embedding array<float>")
    t = spark.createDataFrame([("a", "a", True), ("a", "b", False), ("a", "c", False), ("a", "z", False)], "left string, right string, same_speaker boolean")
    assert {r.right: r.score for r in scoring.score_trials(t, emb).collect()} == {"a": 1.0, "b": 0.5, "c": 0.0, "z": 0.5}
    lost = t.unionByName(spark.createDataFrame([("a", "q", True)], t.schema))
    assert scoring.evaluate(lost, emb).first().status == "missing_embeddings" and scoring.evaluate(lost, emb, compat=True).first().eer == -1
    c = scoring.fit_center(emb).first()
    assert c.mean == pytest.approx([0, 0.5]) and c.std == pytest.approx([np.std([1, 0, -1, 0], ddof=1), np.std([0, 2, 0, 0], ddof=1)])


def test_packing_golden():
    lengths = [1, 2, 1, 4, 3, 1, 2, 2, 3]
    shown = lambda b: [[lengths[i] for i in p] for p in b]
    assert shown(batching.pack(lengths, 5, 1000, False)) == [[1, 1, 1, 2], [2, 2], [3], [3], [4]]
    assert shown(batching.pack(lengths, 4, 4, False)) == [[1, 1, 1], [2, 2], [2], [3], [3], [4]]


def test_max_token_batches(spark):
    df = samples(spark).withColumn("shard_idx", F.col("num_frames") % 3)
    got = batching.batch_max_tokens(df, 900, max_len=300, buffer=5, padded=True)
    sizes = df.join(got.drop("shard_idx"), "key").groupBy("shard_idx", "batch_id").agg((F.count("key") * F.max("num_frames")).alias("cost")).collect()
    assert all(r.cost <= 900 for r in sizes)
    assert got.count() == got.select("key").distinct().count() == df.where("num_frames <= 300").count()
    with pytest.raises(ValueError):
        batching.batch_max_tokens(df, 10, max_len=20)


def test_chunks(spark):
    df = spark.createDataFrame([("a", [float(i) for i in range(10)]), ("b", [1.0, 2.0])], "key string, samples array<float>")
    of = lambda how: sorted((r.key, r.samples) for r in batching.chunk(df, how, 4, rate=1).collect())
    assert of("start") == [("a", [0, 1, 2, 3]), ("b", [1, 2])]
    assert of("contiguous") == [("a", [0, 1, 2, 3]), ("a", [4, 5, 6, 7])]
    a, b = of("random")
    assert len(a[1]) == 4 and a[1] == [a[1][0] + i for i in range(4)] and b[1] == [1, 2]
    with pytest.raises(ValueError):
        batching.chunk(df, "other")


def test_task_pipelines(spark):
    df = samples(spark).withColumns({"samples": F.expr("transform(sequence(1, cast(num_frames / 10 as int)), x -> cast(x as float))"), "shard_idx": F.lit(0).cast("bigint")})
    index = vocab.char_index(vocab.char_vocab(df))
    speakers = vocab.speaker_map(df)
    b = speech_batches(df, index, BatchConfig(max_tokens=900, max_len=400))
    assert b.agg(F.sum("batch_size")).first()[0] == 24 and batching.batch_violations(b).count() == 0
    s = speaker_batches(df, speakers, BatchConfig(batch_size=5, drop_last=True))
    assert s.count() == 4 and batching.batch_violations(s, [0, 1, 2]).count() == 0
    assert gender_batches(df, BatchConfig(batch_size=8, drop_last=False)).count() == 3
    j = joint_batches(df.withColumn("transcription", F.lit(None).cast("string")), index, speakers, BatchConfig(batch_size=8, drop_last=False, filters={"allow_empty": True}))
    assert set(j.select(F.explode("transcriptions")).distinct().first()) == {"none"}
    with pytest.raises(ValueError):
        speech_batches(df, index, BatchConfig())
    bad = spark.createDataFrame([("test", "a", "/x", None), ("test", "a", "/y", None)], "role string, name string, path string, trials string")
    assert [r.rule for r in check_sets(bad).collect()] == ["name_twice"]


def test_splits(spark):
    df = samples(spark, 60, 12)
    one = splits.split_by_group(df, "speaker_id", 0.3)
    assert one.groupBy("speaker_id").agg(F.count_distinct("is_split").alias("n")).where("n > 1").count() == 0
    n = one.where("is_split").count()
    assert n >= 18 and n - 5 < 18
    two = splits.split_balanced(df, "speaker_id", "gender", 0.3).where("is_split").select("speaker_id", "gender").distinct()
    assert two.where("gender = 'm'").count() == two.where("gender = 'f'").count() > 0
    assert manifest.disjoint(one.where("is_split"), one.where("not is_split"), "speaker_id").count() == 0


def test_shards(spark):
    plan = shards.plan_shards(samples(spark, 12), "random", 5).collect()
    sizes = {i: sum(r.shard_idx == i for r in plan) for i in range(3)}
    assert sizes == {0: 5, 1: 5, 2: 2} and {r.shard_idx for r in plan if r.partial_shard} == {2}
    files = spark.createDataFrame([(f"s{i}",) for i in range(7)], "path string")
    assert shards.equal_shards_per_worker(files, 3).count() == 6


def test_parts():
    assert [ordering.parts(n) for n in (0, 1, 1 << 17, (1 << 17) + 1, 36_000_000, 216_000_000, 1 << 32)] == [1, 1, 1, 2, 200, 200, 2048]


def test_shard_lineitem_deals_parts_of_a_fixed_size(spark, monkeypatch):
    monkeypatch.setattr(ordering, "PART_ROWS", (500, 1000))
    dir_ = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{dir_}/lineitem.parquet").count()
    df = QUERIES["shard_lineitem"](spark, dir_)
    assert df.rdd.getNumPartitions() == -(-rows // 500) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    oracle.assert_equal(df, oracle.connect(dir_), ORACLE_SQL["shard_lineitem"])


def all_pairs(members, limit, kind):
    """The round-robin loop over generators, greatest key first."""
    import itertools

    generators = dict(members)
    queue, out = [], []
    iters = {k: iter(itertools.product(*v) if kind == "product" else itertools.combinations(v, 2)) for k, v in generators.items()}
    while iters and (limit is None or len(out) < limit):
        queue = queue or sorted(iters)
        k = queue.pop()
        pair = next(iters[k], None)
        if pair is None:
            del iters[k]
        else:
            out.append(tuple(sorted(pair)))
    return set(out)


@pytest.mark.parametrize("limit", [None, 1, 7, 40, 90])
def test_trials(spark, limit):
    import hashlib
    import itertools

    df = samples(spark, 24, 3)
    order = lambda k: (hashlib.md5(f"{k}|1337".encode()).hexdigest(), k)
    names = [r.key for r in df.collect()]
    by = lambda n: {g: sorted(v, key=order) for g, v in itertools.groupby(sorted(names, key=lambda k: "/".join(k.split("/")[:n])), key=lambda k: "/".join(k.split("/")[:n])) for v in [list(v)]}
    ses, spk = by(3), by(2)
    pos = {f"{a}|{b}": (ses[a], ses[b]) for a in ses for b in ses if a < b and a.split("/")[:2] == b.split("/")[:2]}
    neg = {f"{a}|{b}": (spk[a], spk[b]) for a in spk for b in spk if a < b}
    got = lambda d: {(r.left, r.right) for r in d.collect()}
    assert got(trials.positive_pairs(df, limit=limit)) == all_pairs(pos, limit, "product")
    assert got(trials.positive_pairs(df, session_overlap=True, limit=limit)) == all_pairs(spk, limit, "combinations")
    assert got(trials.negative_pairs(df, same_sex=False, limit=limit)) == all_pairs(neg, limit, "product")
    same = trials.negative_pairs(df, limit=limit).collect()
    assert all(int(r.left.split("/")[1]) % 2 == int(r.right.split("/")[1]) % 2 for r in same)


def test_trial_formats(spark, tmp_path):
    raw = spark.createDataFrame([("1 id1/x/1.wav id1/y/2.wav",), ("",)], "value string")
    t = trials.convert_trials(raw, "vc1")
    assert t.collect() == [("vc1/id1/x/1", "vc1/id1/y/2", True)]
    assert trials.convert_plain_trials(spark.createDataFrame([("a b 0",)], "value string")).first().left == "sre08/unk/unk/a"
    tables.write_trials(t, str(tmp_path / "t"))
    back, bad = tables.read_trials(spark, str(tmp_path / "t"))
    assert back.collect() == t.collect() and bad.count() == 0


def test_manifest_round_trip(spark, tmp_path):
    df = samples(spark, 3).withColumn("transcription", F.lit('say "x" \\ y\tz'))
    tables.write_manifest(df, str(tmp_path / "m"))
    assert sorted(tables.read_manifest(spark, str(tmp_path / "m")).collect()) == sorted(df.collect())
    many = samples(spark, 200).repartition(7)
    tables.write_manifest(many, str(tmp_path / "o"))
    lines = [line.split("\t")[0] for f in sorted((tmp_path / "o").glob("part-*")) for line in f.read_text().splitlines()[1:]]
    assert lines == sorted(r.key for r in many.collect())  # files follow each other in order


def test_violations(spark):
    df = samples(spark, 6).withColumns({"sample_rate": F.lit(8000), "gender": F.lit("x"), "num_frames": F.lit(0).cast("bigint"), "path": F.lit("p")})
    got = {r.rule: r.n for r in manifest.validate_manifest(df, inventory=spark.createDataFrame([("q",)], "path string"), required=["language_tag"]).groupBy("rule").agg(F.count("*").alias("n")).collect()}
    assert got == {"sample_rate": 6, "gender": 6, "num_frames_positive": 6, "duplicate_path": 1, "path_absent": 6}


def test_filters_with_nulls(spark):
    df = samples(spark, 4).withColumns({"transcription": F.expr("case when num_frames = 100 then null else transcription end"), "language_tag": F.expr("case when num_frames = 110 then null else language_tag end")})
    assert manifest.filter_samples(df).count() == 3
    assert manifest.filter_samples(df, allow_empty=True, max_chars=3).count() == 1
    assert manifest.filter_samples(df, tags=["en"], allow_empty=True).count() == 3
    assert manifest.filter_samples(df, max_frames=120, allow_empty=True).count() == 2


def test_tar_round_trip(spark, tmp_path):
    df = samples(spark, 12).withColumn("samples", F.array(*[F.lit(v).cast("float") for v in (0.0, 0.5, -0.5)]))
    wav = F.udf(lambda x: tar.wav_bytes(x), "binary")
    out = str(tmp_path / "shards")
    tar.write_shards(df.withColumn("wav", wav("samples")), shards.plan_shards(df, "length_sorted", 5), out, "part")
    names = sorted(f for f in os.listdir(out) if not f.startswith("."))
    assert names == ["part.000000.tar", "part.000001.tar", "part.000002.partial.tar"]
    with tarfile.open(f"{out}/{names[0]}") as t:
        assert sorted(m.name.split("/")[0] for m in t) == sorted([str(i) for i in range(5)] * 2)
    assert tar.read_shards(spark, out).count() == 10
    back = tar.read_shards(spark, out, allow_partial=True, decode=True, speakers=["ls/1"])
    rows = back.collect()
    assert {r.speaker_id for r in rows} == {"ls/1"} and len(rows) == 4
    assert rows[0].samples == pytest.approx([0, 0.5, -0.5], abs=1e-4) and rows[0].key.startswith("ls/1/")
    assert tables.shard_files(spark, out).count() == 2
    some = tar.of_speakers(tar.read_shards(spark, out), spark.createDataFrame([("ls/1",), ("ls/1",), ("ls/9",)], "speaker_id string"))
    assert {r.speaker_id for r in some.collect()} == {"ls/1"} and some.count() == tar.read_shards(spark, out, speakers=["ls/1", "ls/9"]).count()
    with pytest.raises(ValueError):
        tables.shard_files(spark, out, pattern="*.zip")
    with pytest.raises(Exception, match="no shard matches"):
        tar.read_shards(spark, out, pattern="*.zip").count()
    tar.write_shards(df.withColumn("wav", wav("samples")), shards.plan_shards(df, "random", 5), str(tmp_path / "packed"), "part", compress=True)
    packed = tar.read_shards(spark, str(tmp_path / "packed"), allow_partial=True)
    assert packed.count() == 12 and packed.where(F.col("shard").endswith(".tar.gz")).count() == 12


class Counted(io.BytesIO):
    """A file that counts the bytes that are read from it."""

    read_bytes = 0

    def read(self, n=-1):
        out = super().read(n)
        self.read_bytes += len(out)
        return out


def test_filtered_members_are_not_read(spark, tmp_path):
    big = bytes(300_000)
    content = b"".join(tar.member_bytes(f"{i}/ls/{i % 3}/r/{i}.{end}", big if end == "wav" else b"{}") for i in range(30) for end in ("wav", "json"))
    whole, some = Counted(content + bytes(1024)), Counted(content + bytes(1024))
    assert len(list(tar.pairs(whole, tar.Wanted()))) == 30 and whole.read_bytes > 30 * len(big)
    assert [s for s, _, _ in tar.pairs(some, tar.Wanted(speakers=frozenset(["ls/1"])))] == [f"{i}/ls/1/r/{i}" for i in range(1, 30, 3)]
    assert some.read_bytes < 10 * len(big) + 100_000
    assert len(list(tar.pairs(none := Counted(content), tar.Wanted(), audio=False))) == 30 and none.read_bytes < 100_000
    batches = list(tar.batches_of(io.BytesIO(content + bytes(1024)), "s", tar.Wanted(), True))
    assert len(batches) > 1 and max(b.nbytes for b in batches) < tar.BATCH_BYTES + 2 * len(big)
    with pytest.raises(ValueError, match="no key"):
        list(tar.pairs(io.BytesIO(tar.member_bytes("0/x.wav", b"") + bytes(1024)), tar.Wanted(speakers=frozenset(["ls/1"]))))
    with pytest.raises(ValueError, match="without partner"):
        list(tar.pairs(io.BytesIO(tar.member_bytes("0/ls/1/r/1.wav", b"") + bytes(1024)), tar.Wanted()))
    (tmp_path / "a.tar").write_bytes(content + bytes(1024))
    scan = tar.scan_shards(spark, str(tmp_path)).where(F.col("speaker").isin("ls/1", "ls/2") & (F.col("speaker") != "ls/2") & (F.length("wav") > 0))
    assert scan.count() == 10 and scan.where("key = 'ls/1/r/4'").count() == 1
    # what is pushed is no filter of the plan any more
    plan = tar.scan_shards(spark, str(tmp_path)).where(F.col("speaker").isin("ls/1", "ls/2"))._jdf.queryExecution().executedPlan().toString()
    assert "IN (ls/1" not in plan.split("PushedFilters")[0]


def test_shard_above_two_gigabytes_streams(tmp_path):
    """Batches stay small however large the shard; its audio is a hole in the file."""
    path, size, n = tmp_path / "big.000000.tar", 1 << 20, 2_200
    with open(path, "wb") as f:
        for i in range(n):
            info = tarfile.TarInfo(f"{i:04d}/ls/{i % 2}/r/{i}.wav")
            info.size = size
            f.write(info.tobuf(tarfile.PAX_FORMAT))
            f.seek(size, 1)
            f.write(tar.member_bytes(f"{i:04d}/ls/{i % 2}/r/{i}.json", b"{}"))
        f.write(bytes(2 * tar.BLOCK))
    assert path.stat().st_size > 1 << 31
    reader = tar.ShardReader({"paths": json.dumps([f"file://{tmp_path}"])})
    assert list(reader.pushFilters([EqualTo(("speaker",), "ls/1"), EqualTo(("shard",), "x")])) == [EqualTo(("shard",), "x")]
    (part,) = reader.partitions()
    rows = largest = 0
    for batch in reader.read(part):
        rows, largest = rows + batch.num_rows, max(largest, batch.nbytes)
    assert rows == n / 2 and largest < tar.BATCH_BYTES + 2 * size


def test_shards_on_a_file_system_of_spark_alone(spark, tmp_path):
    (tmp_path / "store").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shards.link./out", f"file://{tmp_path}/store")
    path = "viewfs://shards/out/a"
    df = samples(spark, 12).withColumn("wav", F.encode("key", "UTF-8"))
    plan = shards.plan_shards(df, "random", 5)
    for _ in range(2):  # shards of one name are replaced
        tar.write_shards(df, plan, path, "x")
        back = tar.read_shards(spark, path, allow_partial=True)
        assert sorted((r.key, bytes(r.wav).decode()) for r in back.collect()) == sorted((r.key, r.key) for r in df.collect())
    order = [r.key for r in tar.read_shards(spark, path).where(F.col("shard").contains("000000")).collect()]
    assert order == sorted((r.key for r in plan.where("shard_idx = 0").collect()), key=lambda k: (hashlib.md5(f"{k}|1337".encode()).hexdigest(), k))
    broken = df.withColumn("wav", F.when(F.col("num_frames") > 150, F.raise_error(F.lit("no audio")).cast("binary")).otherwise(F.col("wav")))
    with pytest.raises(Exception, match="no audio"):
        tar.write_shards(broken, plan, "viewfs://shards/out/b", "x")
    assert not [f for _, _, names in os.walk(tmp_path / "store/b") for f in names]


def test_documents(spark, tmp_path):
    def written(pieces, name):
        tables.write_document(pieces, str(tmp_path / name))
        return json.loads((tmp_path / name).read_text())

    df = samples(spark, 6)
    doc = written(vocab.vocabulary_document(vocab.char_vocab(df)), "vocab.json")
    assert doc["characters"][:5] == ["<blank>", "<s>", "</s>", "<unk>", "|"] and doc["char_to_idx"]["d"] == doc["characters"].index("d") and doc["idx_to_char"]["5"] == doc["characters"][5]
    assert doc["char_to_idx"] == {c: i for i, c in enumerate(doc["characters"])} and doc["idx_to_char"] == {str(i): c for i, c in enumerate(doc["characters"])}
    doc = written(vocab.speaker_map_document(vocab.speaker_map(df)), "speakers.json")
    assert doc == {"speakers": ["ls/0", "ls/1", "ls/2"], "speaker_to_idx": {"ls/0": 0, "ls/1": 1, "ls/2": 2}, "idx_to_speaker": {"0": "ls/0", "1": "ls/1", "2": "ls/2"}, "gender": {"ls/0": "m", "ls/1": "f", "ls/2": "m"}}
    odd = spark.createDataFrame([('ls/"\\\n', None), ("ls/é", "f")], "speaker_id string, gender string")
    doc = written(vocab.speaker_map_document(vocab.speaker_map(odd)), "odd.json")
    assert doc["speakers"] == ['ls/"\\\n', "ls/é"] and doc["gender"] == {"ls/é": "f"}
    assert written(vocab.speaker_map_document(vocab.speaker_map(odd.limit(0))), "none.json") == {"speakers": [], "speaker_to_idx": {}, "idx_to_speaker": {}, "gender": {}}
    assert sorted(f for f in os.listdir(tmp_path) if not f.startswith(".")) == ["none.json", "odd.json", "speakers.json", "vocab.json"]
    assert json.loads(vocab.speaker_map_json(vocab.speaker_map(df)).orderBy("value").first().value) == {"idx": 0, "speaker_id": "ls/0", "gender": "m"}
    assert sum(json.loads(vocab.distribution_json(vocab.char_distribution(df)).first().value).values()) == pytest.approx(1)


def test_stats_identities(spark):
    s = stats.corpus_stats(samples(spark)).first()
    assert s.samples == s.samples_m + s.samples_f and s.frames_avg * s.samples / 16000 == pytest.approx(s.seconds_total)
    assert s.speakers == 3 and s.sessions == 2 and s.speaker_sessions == 6
    assert s.frames_q10 == pytest.approx(np.quantile([100 + 10 * i for i in range(24)], 0.1))
    assert stats.corpus_stats(samples(spark).limit(0)).first().samples == 0


def test_calls(spark):
    lines = [("A.1 0.0 0.5 hello"), ("@A.1 0.5 0.5 there you"), ("A.1 * * x"), ("B.1 9.0 1 [noise]"), ("B.2 3.0 4.0 a"), ("")]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "file_id string, line_no int, value string")
    s = calls.assemble_sentences(calls.parse_markup(df)).orderBy("channel").collect()
    assert [(r.channel, r.sentence_no, r.start_s, r.end_s, r.text) for r in s] == [("A", 1, 0.0, 1.0, "hello there you"), ("B", 2, 3.0, 7.0, "a")]
    swapped = calls.parse_markup(df, spark.createDataFrame([("f",)], "file_id string"))
    assert {r.channel for r in swapped.where("token = 'hello'").collect()} == {"B"}
    rec = spark.createDataFrame([("f", [[float(i) for i in range(40)], [0.0] * 40])], "file_id string, channels array<array<float>>")
    seg = calls.segment(calls.assemble_sentences(calls.parse_markup(df)), rec, rate=10).collect()
    assert [(r.channel, r.samples) for r in seg] == [("A", [float(i) for i in range(10)])]
    files = spark.createDataFrame([("1", k, k) for k in ("wav", "txt", "mrk")] + [("2", "wav", "w")], "file_id string, kind string, path string")
    assert calls.match_files(files).count() == 1
    assert {r.file_id for r in calls.split_channels(rec).collect()} == {"f-a", "f-b"}
    pair, alone = calls.zip_stems(spark.createDataFrame([("a", "1"), ("b", "2")], "stem string, path string"), spark.createDataFrame([("a", "3")], "stem string, path string"))
    assert pair.count() == 1 and alone.first().stem == "b"


def test_text_sources(spark, tmp_path):
    def put(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
        return str(path)

    head = ";x\n" * 12
    assert tables.read_librispeech_speakers(spark, put("spk.txt", head + "14   | F | train | 25.03 | Kay | Ray\n")).first().name == "Kay | Ray"
    assert tables.read_voxceleb_metadata(spark, put("vox.csv", "a\tb\tc\td\te\tf\nid1 \t n\tm\tIT\tdev \tvc1\n")).first()[:5] == ("id1", "n", "m", "IT", "dev")
    put("ls/1-2.trans.txt", "1-2-0000 HELLO THERE\n1-2-0001 X\n")
    assert sorted(tables.read_utterance_transcripts(spark, str(tmp_path / "ls")).collect()) == [("1-2-0000", "hello there"), ("1-2-0001", "x")]
    put("sw/s1/c1/transcript.txt", "000012\ta b\n")
    assert tables.read_session_transcripts(spark, str(tmp_path / "sw")).first() == ("s1", "c1", "000012", "a b")
    put("hub/en_1/A/0001.txt", "hi  there\n")
    one = tables.read_single_transcripts(spark, str(tmp_path / "hub")).first()
    assert (one.recording, one.channel, one.utterance, one.text) == ("en_1", "A", "0001", "hi there")
    put("mrk/7.mrk", "A.1 0 1 x\n\nB.1 1 1 y\n")
    assert tables.read_markup(spark, str(tmp_path / "mrk")).count() == 2
    seg = tables.read_reference_segments(spark, put("ref/e1.txt", "# c\n12.30 15.90 A: a: b\n")).first()
    assert (seg.start_s, seg.end_s, seg.channel, seg.text) == (12.3, 15.9, "A", "a: b")
    assert [r.file_id for r in tables.read_id_list(spark, put("ids", "# n\n2001\n\n")).collect()] == [2001]
    assert tables.read_transcript_json(spark, put("t.json", '{"k": {"text": "x", "language": "en", "z": 1}}')).collect() == [("k", "x", "en")]
    whole = wav.wav_file([0.1] * 10, 8000, before=wav.chunk(b"LIST", b"odd") + wav.chunk(b"fact", b"1234"), behind=wav.chunk(b"note", b"x" * 99))
    (tmp_path / "audio/spk/rec").mkdir(parents=True)
    (tmp_path / "audio/spk/rec/u.wav").write_bytes(whole)
    (tmp_path / "audio/other/rec").mkdir(parents=True)
    (tmp_path / "audio/other/rec/u.wav").write_bytes(b"not audio")
    known = spark.createDataFrame([("spk",)], "speaker string")
    assert tables.read_audio_inventory(spark, str(tmp_path / "audio"), known).drop("path").first() == ("spk", "rec", "u", 10, 8000, 1)
    put("head/a.txt", "FILENAME: 4325_b1632_l519\nx")
    put("head/b.txt", "FILENAME: 43_1_2")
    ok, bad = tables.read_call_headers(spark, str(tmp_path / "head"))
    assert ok.first() == ("4325", "1632", "1519") and bad.count() == 1
    assert tables.read_results(spark, put("r.csv", "EER;weights;layer\n0.1;a;3\n")).first() == (0.1, "a", 3)
    callers = ", ".join(['1', '2', '"Y"', '"MALE"'] + ["x"] * 10)
    assert tables.read_callers(spark, put("callers", callers + "\n")).first().sex == "MALE"


def test_signal(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "x array<double>")
    assert df.select(signal.length_normalise(F.col("x"))).first()[0] == [0.6, 0.8]
    assert df.select(signal.right_pad(F.col("x"), F.lit(4), F.lit(0.0))).first()[0] == [3, 4, 0, 0]
    assert df.select(signal.frame_span(F.lit(0.01), F.lit(0.0201), 100)).first()[0] == (1, 3)
    with pytest.raises(ValueError):
        signal.loss_weights([F.lit(1)], "other")


def test_telemetry(spark):
    log = spark.createDataFrame([("r", i, "m", float(i)) for i in range(1, 201)], "run string, step bigint, metric string, value double")
    assert [(r.at_step, r.mean) for r in telemetry.step_means(log).orderBy("at_step").collect()] == [(100, 50.5), (200, 150.5)]
    assert telemetry.best_run(log, "m").first() == ("r", 1, 1.0)
    w = telemetry.dynamic_weights(log.select("run", "step", F.col("value").alias("a"), F.lit(1.0).alias("b")), ["a", "b"], n=3).where("step = 10").first()
    e = math.exp((7 + 8 + 9) / (4 + 5 + 6)), math.exp(1)
    assert w.weight_a == pytest.approx(2 * e[0] / sum(e))
    assert telemetry.best_layer(spark.createDataFrame([(0.2, "a", 1), (0.1, "a", 2)], "eer double, weights string, layer int")).first() == ("a", 2, 0.1)


def rows_of(spark, folders):
    return [tuple(r) for r in spark.read.parquet(*folders).collect()] if folders else []


def test_packed_stream_equals_the_batch_fold(spark, tmp_path):
    schema = "shard_idx bigint, key string, num_frames bigint, arrival timestamp"
    at = lambda s: datetime.datetime.fromtimestamp(1_600_000_000 + s)
    rnd = random.Random(3)
    rows = [(i % 2, f"k{i:03d}", rnd.randint(1, 120), at(i)) for i in range(90)] + [(i % 2, f"k{i:03d}", None, at(90)) for i in (90, 91)]
    src = str(tmp_path / "in")
    # shard 0 ends with a row of its own, shard 1 when the watermark has passed it
    for part in (rows[:30], rows[30:60], rows[60:] + [(0, None, None, at(90))], [(7, "z", 1, at(100_000)), (7, None, None, at(100_000))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    for padded in (True, False):
        stream = streams.packed_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), 100, buffer=5, padded=padded)
        got = rows_of(spark, streams.settled(stream, "append", str(tmp_path / f"out{padded}"), str(tmp_path / f"ck{padded}")))
        batch = batching.batch_max_tokens(spark.createDataFrame(rows, schema).where("num_frames is not null"), 100, buffer=5, padded=padded)
        want = [(r.shard_idx, r.key, r.batch_id, r.place) for r in batch.collect()]
        assert sorted(r for r in got if r[0] < 2) == sorted(want) and len(want) == sum(1 for r in rows if r[2] and r[2] <= 100)


def test_arrivals_of_key(spark, tmp_path):
    at = lambda m: datetime.datetime.fromtimestamp(1_600_000_000 + 60 * m)
    src = str(tmp_path / "in")
    for part in ([("a", at(0)), ("b", at(0)), ("b", at(1))], [("a", at(30)), ("c", at(30))], [("a", at(200)), (None, at(10_000))]):
        spark.createDataFrame(part, "key string, t timestamp").coalesce(1).write.mode("append").parquet(src)
    read = lambda: spark.readStream.schema("key string, t timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    got = rows_of(spark, streams.settled(streams.arrivals_of_key(read(), "t"), "append", str(tmp_path / "o"), str(tmp_path / "c")))
    assert sorted((r[0], r[1], r[3], r[4]) for r in got) == [("a", at(0), 2, 1), ("a", at(200), 1, 0), ("b", at(0), 2, 1), ("c", at(30), 1, 0)]
    first = rows_of(spark, streams.settled(streams.first_of_key(read(), "t").where("key is not null"), "append", str(tmp_path / "o2"), str(tmp_path / "c2")))
    assert sorted(r[0] for r in first) == ["a", "b", "c"]  # the watermark has not passed a yet


def test_enrich_stream(spark, tmp_path):
    src, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    compute = lambda d: d.select("key", F.upper("text").alias("text"))
    for k, rows in enumerate(([("a", "x"), ("b", "y")], [("b", "z"), ("c", "w")])):
        spark.createDataFrame(rows, "key string, text string").write.mode("append").parquet(src)
        streams.enrich_stream(spark.readStream.schema("key string, text string").parquet(src), cache, compute, str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.key, r.text) for r in spark.read.parquet(cache).collect()) == [("a", "X"), ("b", "Y"), ("c", "W")]
    # a query that starts over finds all keys
    streams.enrich_stream(spark.readStream.schema("key string, text string").parquet(src), cache, compute, str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(cache).count() == 3


def test_wav_headers():
    read = lambda data: wav.wav_header(io.BytesIO(data), len(data))
    plain = wav.wav_file([0.0] * 7)
    assert len(plain) == 44 + 14 and read(plain) == (7, 16000, 1)
    open_ended = plain.replace(b"data" + (14).to_bytes(4, "little"), b"data" + b"\xff" * 4)
    assert read(open_ended) == (7, 16000, 1) and read(open_ended.replace(b"\xff" * 4, bytes(4))) == (7, 16000, 1)
    stereo = bytearray(plain)
    stereo[22], stereo[32] = 2, 4
    assert read(bytes(stereo)) == (3, 16000, 2)
    seen = tar.wav_samples(wav.wav_file([0.5, -0.5], before=wav.chunk(b"LIST", b"abc")))
    assert seen == pytest.approx([0.5, -0.5], abs=1e-4)
    for bad in (b"", b"RIFF0000WAVE", plain[:36], b"RIFF0000WAVEdata\x00\x00\x00\x00"):
        with pytest.raises(ValueError):
            read(bad)
    long = Counted(wav.wav_file([0.0] * 100_000, before=wav.chunk(b"big ", bytes(50_000))))
    assert wav.wav_header(long, len(long.getvalue()))[0] == 100_000 and long.read_bytes < 100


def test_named_text_files(spark, tmp_path):
    rows = [(f"a={i % 3}/é %{i % 3}.txt", 9 - i, f"line {9 - i}") for i in range(10)]
    tables.write_named_text(spark.createDataFrame(rows, "file string, at int, value string").repartition(4), str(tmp_path / "t"))
    for k in range(3):
        got = (tmp_path / "t" / f"a={k}" / f"é %{k}.txt").read_text().split("\n")
        assert got == [f"line {9 - i}" for i in range(9, -1, -1) if i % 3 == k] + [""]
    assert not [f for f in os.listdir(tmp_path / "t") if "staging" in f]


def test_named_text_files_are_written_in_parallel(spark, tmp_path):
    rows = spark.range(300).select(F.format_string("d%d/%d.txt", F.col("id") % 7, "id").alias("file"), F.lit(0).alias("at"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("value"))
    run = storage.place_files

    def counted(batches, path):
        from pyspark import TaskContext

        for batch in run(batches, path):
            with open(f"{tmp_path}/task{TaskContext.get().partitionId()}", "w") as f:
                f.write(str(batch.column(0)[0]))
            yield batch

    tables.place_files = counted
    try:
        tables.write_named_text(rows.coalesce(1), str(tmp_path / "t"))
    finally:
        tables.place_files = run
    tasks = [f for f in os.listdir(tmp_path) if f.startswith("task")]
    assert len(tasks) == 4 and sum(int((tmp_path / f).read_text()) for f in tasks) == 300
    assert (tmp_path / "t" / "d0" / "0.txt").read_text() == "0\n" and (tmp_path / "t" / "d1" / "1.txt").read_text() == "\n"
    # files that are there are replaced, others stay
    tables.write_named_text(rows.where("id < 2").withColumn("value", F.lit("new")), str(tmp_path / "t"))
    assert (tmp_path / "t" / "d0" / "0.txt").read_text() == "new\n" and (tmp_path / "t" / "d2" / "2.txt").read_text() == "2\n"
    assert sum(len(files) for _, _, files in os.walk(tmp_path / "t")) == 300
    bad = rows.unionByName(rows.limit(1).withColumn("file", F.lit(None).cast("string")))
    with pytest.raises(Exception, match="a file has no name"):
        tables.write_named_text(bad, str(tmp_path / "u"))
    assert sorted(f for f in os.listdir(tmp_path) if not f.startswith("task")) == ["t"]


def test_manifest_keeps_empty_strings_apart_from_nulls(spark, tmp_path):
    rows = [("ls/1/2/3", "/a", 1, 16000, "ls/1", "ls/2", "m", "en", ""), ("ls/1/2/4", "/b", 1, 16000, "ls/1", "ls/2", "m", "", None), ("ls/1/2/5", "/c", 1, 16000, "ls/1", "ls/2", None, None, "x")]
    tables.write_manifest(spark.createDataFrame(rows, MANIFEST), str(tmp_path / "m"))
    back = tables.read_manifest(spark, str(tmp_path / "m"))
    assert sorted(tuple(r) for r in back.collect()) == rows
    assert back.where("transcription = ''").count() == 1 and back.where("transcription is null").count() == 1


def test_worker_shards_of_long_numbers(spark, tmp_path):
    numbers = [999_999, 1_000_000, 1_000_001, 1_100_000, *range(10)]
    spark.createDataFrame([(n,) for n in numbers], "p_partkey bigint").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    oracle.assert_equal(QUERIES["worker_shards"](spark, str(tmp_path)), con, ORACLE_SQL["worker_shards"])


def test_large_parts_arrive_in_several_files(spark, monkeypatch):
    rows = spark.range(0, 3000, numPartitions=6).select(F.when(F.col("id") < 2990, F.format_string("%05d", "id")).alias("key"), F.md5(F.col("id").cast("string")).alias("text"), (F.col("id") % 2 * 2).alias("part"))
    held = lambda path: sorted((os.path.getmtime(f"{path}/{f}"), sorted(r[0] or "~" for r in spark.read.parquet(f"{path}/{f}").select("key").collect())) for f in os.listdir(path) if f.startswith("part-"))
    monkeypatch.setattr(catalogue, "ARRIVING_BYTES", 20_000)
    for order in (None, F.col("key").asc_nulls_last()):
        path = catalogue._in_files(rows, F.col("part"), order)
        files = [keys for _, keys in held(path) if keys]
        assert len(files) >= 6 and sum(map(len, files)) == 3000 and max(map(len, files)) < 1000
        if order is not None:
            assert all(a[-1] <= b[0] for half in (files[: len(files) // 2], files[len(files) // 2 :]) for a, b in zip(half, half[1:]))
    monkeypatch.undo()
    assert sum(len(keys) > 0 for _, keys in held(catalogue._in_files(rows, F.col("part")))) == 2


def test_edit_distance_of_long_sequences():
    random.seed(3)
    for n, errors, words in ((700, 0, 50), (700, 30, 9), (900, 400, 300), (600, 900, 3), (1500, 70, 97)):
        x = [str(random.randrange(words)) for _ in range(n)]
        y = list(x)
        for _ in range(errors):
            at = random.randrange(len(y))
            y[at : at + random.randrange(2)] = [str(random.randrange(words))] * random.randrange(2)
        want = edit(x, y)
        assert text.edit_distance(x, y) == text.edit_distance(y, x) == want
        for band in (1, 7, 64, max(want, 1), 2000):  # exact within the band, never too small
            got = text._banded(x, y, band)
            assert got == want if want <= band else got > band
    x = [str(i) for i in range(700)]
    assert text.edit_distance(x, x[300:]) == 300 and text.edit_distance(x[600:], x) == 600 and text.edit_distance(x, ["z"] * 5) == 700 and text.edit_distance([], x) == 700


def test_call_headers_of_long_numbers(spark, tmp_path):
    numbers = [0, 6, 7, 999, 1000, 9998, 9999, 10_000, 10_003, 12_345, 123_456, 1_234_567, None]
    spark.createDataFrame([(n,) for n in [*numbers, 6]], "conv_id bigint").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    oracle.assert_equal(QUERIES["call_headers"](spark, str(tmp_path)), con, ORACLE_SQL["call_headers"])


def test_violations_of_empty_documents(spark, tmp_path):
    rows = [(i, "" if i % 50 == 7 else "x" * (i + 1), "en", f"src{i % 9}", 0 if i % 50 == 7 else i + 1) for i in range(200)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("manifest_violation_rows", "manifest_violations"):
        oracle.assert_equal(QUERIES[name](spark, str(tmp_path)), con, ORACLE_SQL[name])
    assert QUERIES["manifest_violations"](spark, str(tmp_path)).where("rule = 'num_frames_positive'").first().n == 4


def test_shards_stream_in_batches_that_follow_the_cores(spark, monkeypatch):
    """Eight shards are one batch; batches of four, however many cores, cost more than their shards."""
    dir_, batches = "/root/testdata/sf0.01", []
    settled = streams.settled
    monkeypatch.setattr(streams, "settled", lambda *args: batches.extend(folders := settled(*args)) or folders)
    listing = spark.conf.get(streams.LISTING)
    oracle.assert_equal(QUERIES["stream_shards"](spark, dir_), oracle.connect(dir_), ORACLE_SQL["stream_shards"])
    assert len(batches) == 1 and spark.conf.get(streams.LISTING) == listing


def plain_shuffle(group, keys, buffer, seed, epoch):
    draw = lambda n: int(hashlib.md5(f"{group}|{epoch}|{seed}|{n}".encode()).hexdigest()[:8], 16)
    held, out = [], []
    for n, k in enumerate(keys):
        if len(held) < buffer:
            held.append(k)
        else:
            at = draw(n) % buffer
            out.append(held[at])
            held[at] = k
    return out + sorted(held, key=lambda k: (hashlib.md5(f"{k}|{epoch}|{seed}".encode()).hexdigest(), k))


def test_buffer_shuffle(spark):
    rows = [(i % 3, f"k{i:03d}") for i in range(100)] + [(9, "only")]
    df = spark.createDataFrame(rows, "shard_idx bigint, key string").repartition(5)
    for buffer, seed, epoch in ((1, 0, 0), (7, 1, 2), (1000, 5, 0)):
        got = {}
        for r in batching.buffer_shuffle(df, buffer, seed=seed, epoch=epoch).orderBy("shard_idx", "place").collect():
            got.setdefault(r.shard_idx, []).append(r.key)
        assert got == {g: plain_shuffle(g, sorted(k for h, k in rows if h == g), buffer, seed, epoch) for g in (0, 1, 2, 9)}
        for g, keys in got.items():  # a key comes at most ``buffer`` places early
            assert all(place >= int(sorted(keys).index(k)) - buffer for place, k in enumerate(keys))
    assert batching.buffer_shuffle(df.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        batching.buffer_shuffle(df, 0)


def test_evaluate_sets(spark):
    e = [("x", "a", [1.0, 0.0]), ("x", "b", [0.9, 0.1]), ("x", "c", [0.0, 1.0]), ("y", "a", [0.0, 1.0]), ("y", "b", [1.0, 0.0]), ("y", "c", [0.0, 0.9])]
    t = [(s, "a", o, o == "b") for s in "xy" for o in "bc"]
    emb = spark.createDataFrame(e, "set string, sample_id string, embedding array<double>")
    trial = spark.createDataFrame(t, "set string, left string, right string, same_speaker boolean")
    words = spark.createDataFrame([("y", "a b c d", "a x c d"), ("z", "a b", "a b c"), ("x", "q", "")], "set string, ref string, hyp string")
    sets = spark.createDataFrame([("x", "speaker"), ("y", "joint"), ("z", "speech"), ("none", "joint")], "name string, mode string")
    got = {r.key: (r.value, r.status) for r in scoring.evaluate_sets(sets, trial, emb, words).collect()}
    assert len(got) == 4 * 3 + 3
    assert got["test_eer_x"] == (0.0, "ok") and got["test_eer_y"] == (1.0, "ok") and got["test_wer_y"] == (0.25, "ok") and got["test_wer_z"] == (0.5, "ok")
    assert got["test_eer_none"] == (None, "no_trials") and got["test_wer_none"] == (None, "no_words")
    lacking = {r.key: (r.value, r.status) for r in scoring.evaluate_sets(sets, trial, emb.where("not (set = 'x' and sample_id = 'c')"), words, compat=True).collect()}
    assert lacking["test_eer_x"] == (-1.0, "missing_embeddings") and lacking["test_eer_y"] == (1.0, "ok")
    # a scorer of one's own
    class Negative(scoring.CosineScorer):
        def score(self, left, right, left_norm, right_norm):
            return 1 - super().score(left, right, left_norm, right_norm)

    turned = {r.key: r.value for r in scoring.evaluate_sets(sets, trial, emb, words, scorer=Negative()).collect()}
    assert turned["test_eer_x"] == 1.0 and turned["test_eer_y"] == 0.0
    with pytest.raises(ValueError, match="unknown mode"):
        scoring.evaluate_sets(spark.createDataFrame([("x", "video")], "name string, mode string"), trial, emb, words)


def test_set_composition(spark):
    of = lambda rows: spark.createDataFrame([(r, i, v) for r, vs in rows.items() for i, v in enumerate(vs)], "role string, place int, value string")
    sets = compose_sets(of({"test": ["a", "b"], "val": ["c"]}), of({"test": ["/a", "/b"], "val": ["/c", "/d"]}), of({"test": ["t"], "val": ["u"]}))
    assert sets.where("role = 'val' and place = 1").first()[2:] == (None, "/d", None)
    assert sorted(map(tuple, check_sets(sets, ("test",)).collect())) == [("test", "name_and_trials_differ"), ("val", "incomplete"), ("val", "name_and_path_differ"), ("val", "trials_not_used")]


def test_transcript_errors_by_plain_alignment(spark):
    """The edit distance against a plain table of costs, all three kinds of error included."""
    rnd = random.Random(31)
    rows = []
    for i in range(60):
        ref = [rnd.choice("abcde") for _ in range(rnd.randint(0, 30))]
        hyp = [w for w in ref if rnd.random() > 0.15]
        for _ in range(rnd.randint(0, 5)):
            hyp.insert(rnd.randint(0, len(hyp)), rnd.choice("abcdef"))
        hyp = [rnd.choice("abcdefg") if rnd.random() < 0.15 else w for w in hyp]
        rows.append((i, " ".join(ref), " ".join(hyp)))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    got = {r.i: r.errors for r in asr.pair_errors(spark.createDataFrame(rows, "i int, ref string, hyp string")).collect()}
    assert got == {i: distance(a.split(), b.split()) for i, a, b in rows}


def test_check_scores(spark):
    rows = [(1, 0.5), (0, 0.0), (2, 0.5), (1, None), (0, float("nan")), (None, 0.1), (1, 1.5), (0, -0.1)]
    df = spark.createDataFrame(rows, "y int, score double")
    assert scoring.check_scores(df).count() == 6
    assert scoring.eer(df).first().status == "bad_scores"


def test_characters(spark, monkeypatch):
    monkeypatch.setattr(vocab, "CHARACTER_BYTES", 7)
    texts = ["abc a", None, "", "été 😀😀", "x" * 50, " \t\n", "é"]
    want = collections.Counter("".join(t or "" for t in texts))
    rows = spark.createDataFrame([(t,) for t in texts], "transcription string").repartition(3)
    got = {r.char: r.n for r in vocab.characters(rows).groupBy("char").agg(F.sum("n").alias("n")).collect()}
    assert got == want
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["transcription"]).slice(1)
    assert dict(zip(*(c.to_pylist() for c in next(vocab._counted(iter([batch]))).columns))) == want - collections.Counter("abc a")
    assert vocab.characters(rows.limit(0)).count() == 0
