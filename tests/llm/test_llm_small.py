"""Small cases of the training-text operators against brute force: nulls, ties, repeats, empty and odd tables."""

import hashlib
import json
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.llm._common import Scratch
from tastemill.llm import components, exact_dedup, language_id, mixing, ngram_join, packing, ppm, quality_rules, token_counts, token_shards, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: A column with the name of an inner one, and one in capitals.
ODD = SCHEMA + ", maybe string, row int, dedup_h int"
PIECES = "the of and song light winter river stone bird morning under over glass paper garden window".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(PIECES, n))


def docs(spark, texts, schema=ODD, sources=("a", "b", None)):
    rows = [(i, t, ("en", None)[i % 7 == 6], sources[i % len(sources)], len(t or ""), "x", 1, 2)[: schema.count(",") + 1] for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


TEXTS = [None, "", " \n ", "one", prose(1, 40), prose(1, 40), prose(2, 60), None, "x" * 5000, prose(3, 3000), "§ é\u3000漢字 <|endoftext|> ok", prose(1, 40) + " end"]


@pytest.fixture(scope="module")
def some(spark):
    return docs(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, []).cache()


# 1: exact dedup


def test_dedup(spark, some, empty):
    got = {r["doc_id"]: r for r in exact_dedup.mark_exact_duplicates(some).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[t or ""].append(i)
    assert len(got) == len(TEXTS)
    for t, own in groups.items():
        for i in own:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(own), len(own), i == max(own))
            assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    left = exact_dedup.drop_exact_duplicates(some)
    assert left.columns == some.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(max(v) for v in groups.values())
    assert exact_dedup.mark_exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_dedup_ties_nulls_and_a_full_filter(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c")] + [(10 + i, f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"max_filter_bytes": 4096, "bits_per_row": 1}):
        marks = exact_dedup.mark_exact_duplicates(df, **options).collect()
        assert sum(r["kept"] for r in marks) == 303 and len(marks) == 306
        assert exact_dedup.drop_exact_duplicates(df, **options).count() == 303


def test_few_unique_rows_are_flagged_at_any_size(spark):
    """The filter grows with the rows: also where it is too large to be broadcast, only a few unique rows are flagged."""
    rows = spark.range(30_000).select(F.xxhash64("id").alias("h"), F.col("id").alias("row")).unionByName(spark.range(100).select(F.xxhash64("id").alias("h"), (F.col("id") + 30_000).alias("row")))
    filter_, segments = exact_dedup.repeat_filter(rows.select("h"), 30_100)
    for most in (64 << 20, 4096):
        flagged = exact_dedup.probe(rows, F.col("h"), filter_, segments, "maybe", most).where("maybe")
        assert flagged.where("row < 100 or row >= 30000").count() == 200 and flagged.count() < 200 + 30_000 * 0.02


# 2: packing


def test_plan_is_complete_and_full():
    rng = np.random.default_rng(5)
    for cap, n in ((10, 50), (100, 500), (2048, 3000)):
        h = Counter(int(x) for x in rng.integers(1, cap + 1, n))
        plan = packing.packing_plan(h, cap)
        used = Counter()
        for c, times in plan:
            assert sum(c) <= cap
            for x in c:
                used[x] += times
        assert used == h
        total = sum(k * v for k, v in h.items())
        best_fit = []
        for x in sorted(h.elements(), reverse=True):
            fits = [i for i, b in enumerate(best_fit) if b + x <= cap]
            i = max(fits, key=best_fit.__getitem__, default=None)
            if i is None:
                best_fit.append(x)
            else:
                best_fit[i] += x
        bins = sum(t for _, t in plan)
        assert -(-total // cap) <= bins <= len(best_fit)


def test_fullest_against_all_subsets():
    from itertools import product

    for counts, room in (({3: 2, 5: 1, 7: 1}, 11), ({4: 3}, 11), ({9: 1}, 8), ({2: 5, 3: 1}, 12)):
        best = max(s for pick in product(*[range(c + 1) for c in counts.values()]) if (s := sum(n * x for n, x in zip(pick, counts))) <= room)
        got = packing.fullest(counts, room)
        assert sum(got) == best and all(got.count(x) <= c for x, c in counts.items())


def test_pack_documents(spark, some, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    rows = packing.pack_documents(some, WORD, capacity=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in enumerate(TEXTS):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), 256))
        for r in own:
            part = ids[r["start"] : r["start"] + 256]
            assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert packing.pack_documents(empty, WORD).count() == 0


def test_pipeline_returns_the_sequences(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline

    t = Tokenizer.from_file(WORD)
    df = docs(spark, [prose(i, 30 + 90 * i) for i in range(30)], sources=("a", "b", "a"))
    mixed = corpus_pipeline.written(corpus_pipeline.mix(spark, df, ""), "test-mix")
    rows = corpus_pipeline.pack(spark, mixed, "").collect()
    sequences = defaultdict(bytes)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert len(sequences[r["sequence_id"]]) == 4 * r["offset"] and len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences[r["sequence_id"]] += r["ids"]
    want = Counter(x for r in mixed.collect() for x in (*t.encode(r["text"] or "", add_special_tokens=False).ids, 0))
    assert Counter(np.frombuffer(b"".join(sequences.values()), "<u4").tolist()) == want


# 3: language


def test_pipeline_reads_whole_texts_in_small_batches(spark):
    """Large ones let every executor's heap grow to its limit."""
    import corpus_pipeline

    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(x, None) for x in names]
    try:
        assert corpus_pipeline.identify(spark, docs(spark, [prose(i, 30) for i in range(8)]), "").count() == 8
        assert [int(spark.conf.get(x)) for x in names] == [250, 512]
    finally:
        for x, old in zip(names, before):
            spark.conf.unset(x) if old is None else spark.conf.set(x, old)


def test_small_tables_need_no_python_workers(spark):
    """Those would be of another kind than the operators', and stay beside them in each executor."""
    from tastemill.llm._common import small_table

    lineage = lambda df: df._jdf.queryExecution().toRdd().toDebugString()
    rows = [("a", 1), (None, 1 << 40), ("b", None)]
    table = small_table(spark, rows, "lang string, total long")
    assert [tuple(r) for r in table.collect()] == rows and "PythonRDD" not in lineage(table)
    assert small_table(spark, [], "x int, y array<long>").collect() == []
    pieces = spark.createDataFrame([(i, 0, 5, i) for i in range(9)], "doc_id long, piece int, length long, ids_crc32 long").cache()
    pieces.count()
    placed = packing.pack(pieces, 16)
    assert placed.count() == 9 and "LocalRelation [len" in placed._jdf.queryExecution().optimizedPlan().toString()


def test_language(spark, empty):
    words = {"aa": "lor mel tin sab", "bb": "qux vyz wok pum"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[k].split(), 30)), k, "s", 1) for i in range(60) for k in [("aa", "bb")[i % 2]]]
    rows += [(100, None, "aa", "s", 1), (101, "12 !", "bb", "s", 1), (102, "mel", None, None, 1), (103, "q", "aa", "s", 1), (102, "mel", None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    held = language_id.training_fold(F.col("doc_id"), 3) == 1
    got = language_id.identify(df, held).collect()
    assert len(got) == len(rows)
    for r, row in zip(sorted(got, key=lambda r: r["doc_id"]), sorted(rows, key=lambda r: r[0])):
        assert r["held_out"] == (zlib.crc32(str(row[0]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == ("und" if row[0] in (100, 101) else "aa" if row[0] == 102 else row[2] if row[0] < 100 else r["lang_pred"])
    kept = language_id.keep_identified(df, 0.2)
    assert kept.columns == df.columns and {100, 101} & {r["doc_id"] for r in kept.collect()} == set()
    assert language_id.identify(empty, held).count() == 0 and language_id.keep_identified(empty).count() == 0
    assert language_id.keep_identified(docs(spark, ["a b c d"], sources=("s",)).withColumn("lang", F.lit(None).cast("string"))).count() == 0


@pytest.mark.parametrize("options", [{}, {"min_share": 0.002, "contrast": 0.5}, {"min_share": 0.0, "contrast": 0.0}])
def test_language_against_exact_sets(spark, options):
    """Three languages that share words: decisions and scores of exact n-gram sets, with and without pruning; one long text."""
    words = {"aa": "lor mel tin sab dur", "bb": "lor mel wok pum zad", "cc": "tin sab wok qux vyz"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[k].split(), 3 + i % 9)), k, "s", 1) for i in range(90) for k in [("aa", "bb", "cc")[i % 3]]]
    rows += [(200, " ".join(rng.choice(words["bb"].split(), 400_000)), "bb", "s", 1), (201, "mel lor", "aa", None, 1), (201, "mel lor", "aa", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit(1), "l": F.lit("x"), "score": F.lit(0)})
    grams = lambda t: (lambda d: [d[i : i + 4] for i in range(len(d) - 3)])(language_id.prepared(t))
    n = {k: Counter() for k in words}
    for _, t, k, _, _ in rows:
        n[k].update(grams(t))
    share = {k: {g: c / sum(n[k].values()) for g, c in n[k].items()} for k in n}
    least, contrast = options.get("min_share", 1e-5), options.get("contrast", 0.2)
    kept = {k: {g for g, v in share[k].items() if v >= least} for k in n}
    kept = {k: {g for g in kept[k] if share[k][g] >= contrast * max(share[j][g] for j in n if g in kept[j])} for k in n}
    filters = language_id.train_filters(df.select("text", "lang"), slots=1 << 22, **options)
    got = language_id.predict(df, filters, lang_pred="said", score="sure").collect()
    assert len(got) == len(rows)
    for r in got:
        g = [x for x in grams(r["text"]) if x != b"    "]
        hits = {k: sum(x in kept[k] for x in g) for k in sorted(n)}
        best = max(hits, key=hits.get)
        assert r["said"] == best and abs(r["sure"] - hits[best] / len(g)) < 1e-3


def test_filters_return_all_languages():
    names = [f"l{k:02d}" for k in range(70)]
    f = language_id.Filters(names, 1 << 16)
    g = language_id.grams(b"abcdefgh")
    for k in (0, 5, 69):
        f.add(g, np.full(len(g), k))
    f.close()
    n, hits = f.hits(b"abcdefgh")
    assert n == 5 and [k for k in range(70) if hits[k] == 5] == [0, 5, 69]


# 4: token counts


def test_counts_and_all_prefixes(spark, some, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(some, BYTE, limit=50).collect()}
    for i, x in enumerate(TEXTS):
        assert (got[i]["n_tokens"], got[i]["n_bytes"]) == (count(x or ""), len((x or "").encode()))
        assert got[i]["over_limit"] == (got[i]["n_tokens"] > 50)
        whole, fit = x or "", got[i]["fit_chars"]
        ends = [m.end() for m in re.finditer(r"\s*[^\s]+", whole)] if "<|" not in whole else []
        if not got[i]["over_limit"]:
            assert fit == len(whole)
        elif ends and len(whole) < 5000:
            assert fit == max([e for e in ends if count(whole[:e]) <= 50], default=0)
    counter = token_counts.counter_of(BYTE)
    for x in ("it's  we'll\n\n go 12x <|endoftext|>  on", "é漢字 \u3000\x85 \x1c!", prose(4, 12)):
        table = token_counts.PrefixTable(counter, x)
        assert [table.count(k) for k in range(len(x) + 1)] == [count(x[:k]) for k in range(len(x) + 1)]
        for most in (0, 3, 10**6):
            assert count(x[: table.longest(most)]) <= most
    assert token_counts.count_tokens(empty, BYTE).count() == 0


# 5: quality


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c, covered, seen, dup = Counter(win), set(), set(), 0
    for i, x in enumerate(win):
        if c[x] > 1:
            covered |= set(range(i, i + 5))
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), dup, len(covered)


def test_quality(spark, empty):
    texts = [prose(i, 30 + i % 50) for i in range(200)] + [None, "", "a b", "# $ % " * 30 + prose(1, 20), "spam line here\n" * 40, prose(7, 20) + "\n" + prose(7, 20), "a\n\na\n \n b\r\nb"]
    got = {r["doc_id"]: r for r in quality_rules.judge_quality(docs(spark, texts, sources=("s",))).collect()}
    for i, x in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(x), i
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert not got[203]["kept"] and not got[204]["kept"]
    assert sum(got[i]["kept"] for i in range(200)) == sum(not got[i]["base_failed"] for i in range(200))
    assert quality_rules.judge_quality(empty).count() == 0


VECTOR_SCHEMA = ", ".join(f"x{i} double" for i in range(5))


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], f"g string, {VECTOR_SCHEMA}")
    floors = (0.1,) * 5
    got = np.array([r["d2"] for r in quality_rules._distance(df, quality_rules._moments(df, ["g"], None, floors, 1.0, 0.0, Scratch(spark, "test"))).orderBy("x0").collect()])
    x = x[np.argsort(x[:, 0])]
    inverse = np.linalg.inv(np.cov(x.T, bias=True) + 0.01 * np.eye(5))
    d = x - x.mean(0)
    assert np.allclose(got, np.einsum("ij,jk,ik->i", d, inverse, d))


def slow_estimate(x, prior, floors, prior_rows, subset=0.75):
    """Centre and covariance of the smallest determinant over all subsets of the wanted size, with the prior's rows added."""
    from itertools import combinations

    m0, c0 = prior
    h, best = math.ceil(subset * len(x)), None
    for pick in combinations(range(len(x)), h):
        own = x[list(pick)]
        a, w = own.mean(0), prior_rows
        m = (h * a + w * m0) / (h + w)
        s = (h * np.cov(own.T, bias=True) + h * w / (h + w) * np.outer(a - m0, a - m0)) / quality_rules.TRIMMED[subset]
        c = (s + w * c0) / (h + w) + np.diag(np.square(floors)) * h / (h + w)
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = det, m, c
    return best[1:]


@pytest.mark.parametrize("seed", range(3))
def test_verdicts_against_all_subsets(spark, seed):
    """Two small sources of one language with outliers: the centres, distances and verdicts of the exact minimum."""
    rng = np.random.default_rng(seed)
    shape = rng.normal(size=(5, 5)) * 0.3
    part = lambda n, far, shift: np.vstack([rng.normal(size=(n, 5)) @ shape + shift, rng.normal(size=(far, 5)) * 0.2 + shift + 9])
    x = {"a": part(8, 2, 0.0), "b": part(5, 1, 0.5)}
    floors, w = (0.3,) * 5, 4.0
    rows = [("en", s, *map(float, r)) for s, own in x.items() for r in own]
    got = quality_rules.robust_distances(spark.createDataFrame(rows, f"lang string, source string, {VECTOR_SCHEMA}"), floors, 0.75, w).collect()
    whole = np.vstack(list(x.values()))
    middle = lambda v: np.array([np.sort(c)[math.ceil(0.5 * len(c)) - 1] for c in v.T])
    centre = middle(whole)
    lang = slow_estimate(whole, (centre, np.diag(np.maximum(1.4826 * middle(np.abs(whole - centre)), floors) ** 2)), floors, w)
    for s, own in x.items():
        m, c = slow_estimate(own, lang, floors, w)
        want = [(r - m) @ np.linalg.inv(c) @ (r - m) for r in own]
        d2 = {r["x0"]: r["d2"] for r in got if r["source"] == s}
        assert np.allclose([d2[float(r[0])] for r in own], want, rtol=1e-6)
        far = len(own) * 2 // 10
        assert all(v > 35 for v in want[-far:]) and all(v < 35 for v in want[:-far])


def test_quality_of_odd_rows(spark):
    """Null languages and sources, repeated rows, one very long text, groups of one row."""
    texts = [prose(i, 40) for i in range(30)] + [prose(99, 60_000), prose(5, 40), None]
    rows = [(i % 31, t, (None, "en")[i % 2], (None, "s", f"own{i}")[i % 3], 1) for i, t in enumerate(texts)]
    got = quality_rules.judge_quality(spark.createDataFrame(rows, SCHEMA).withColumns({"g": F.lit(1), "d2": F.lit("x"), "by_lang": F.lit(0)})).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    assert [r["kept"] for r in got if r["n_words"] == 0] == [False] and all(r["kept"] for r in got if 0 < r["n_words"] < 100 and not r["base_failed"])


# 6: shards


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 5000])
def test_feistel(n):
    y = token_shards.feistel(np.arange(n), n, "key")
    assert sorted(y.tolist()) == list(range(n)) and (token_shards.unfeistel(y, n, "key") == np.arange(n)).all()
    assert n < 100 or (y != token_shards.feistel(np.arange(n), n, "other")).any()


def test_shards(spark, some, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    rows = token_shards.write_shards(some, BYTE, "k", length=32, per_shard=50).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    folder = rows[0]["file"].rsplit("/", 1)[0]
    records = list(token_shards.read_slots(folder, 0, len(rows), length=32, per_shard=50))
    text = defaultdict(dict)
    for r, x in zip(rows, records):
        assert r["ids_crc32"] == zlib.crc32(x[: r["n_tokens"]].tobytes()) and (x[r["n_tokens"] :] == 50256).all()
        text[r["doc_id"]][r["piece"]] = x[: r["n_tokens"]].tolist()
    for i, x in enumerate(TEXTS):
        assert sum((text[i][p] for p in sorted(text[i])), []) == [*t.encode(x or "", add_special_tokens=False).ids, 50256]
    assert (list(token_shards.read_slots(folder, 60, 5, length=32, per_shard=50))[0] == records[60]).all()
    assert token_shards.write_shards(empty, BYTE, "k").count() == 0


def test_shards_do_not_depend_on_partitions(spark, some, tmp_path):
    """The same bytes and slots however the rows are dealt to tasks, also where several shards share a partition."""
    df = some.unionByName(docs(spark, [prose(i, 50 + 7 * i) for i in range(40)]))
    found = []
    for k, (dealt, most) in enumerate(((df.coalesce(1), 20_000), (df.repartition(7), 2))):
        rows = token_shards.write_shards(dealt, BYTE, "k", length=16, per_shard=64, to=f"file://{tmp_path}/{k}", most_partitions=most).drop("file")
        found.append((sorted(map(tuple, rows.collect()), key=repr), {p.name: p.read_bytes() for p in sorted((tmp_path / str(k)).glob("*.bin"))}))
    assert found[0] == found[1] and len(found[0][1]) > 4
    again = token_shards.write_shards(df, BYTE, "k", length=16, per_shard=64, to=f"file://{tmp_path}/0").drop("file")
    assert sorted(map(tuple, again.collect()), key=repr) == found[0][0]
    assert {p.name: p.read_bytes() for p in (tmp_path / "0").glob("*.bin")} == found[0][1] and not list((tmp_path / "0").glob(".*.tmp"))


def test_shards_come_in_waves(spark, monkeypatch):
    """Each wave deals its own half of the sequences, and no shuffle file stays after the last."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    left = lambda: {p for d in env.blockManager().diskBlockManager().localDirs() for p in Path(str(d)).rglob("shuffle_*.data")}
    waves, write, before = [], token_shards.written, left()
    monkeypatch.setattr(token_shards, "written", lambda df, name: (waves.append(out := write(df, name)), out)[1])
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    rows = token_shards.write_shards(docs(spark, [prose(i, 400) for i in range(40)]), BYTE, "k", length=16, per_shard=64)
    own = [{r["shard"] for r in w.select("shard").distinct().collect()} for w in waves]
    assert len(own) == token_shards.WAVES == 2 and not own[0] & own[1] and abs(len(own[0]) - len(own[1])) <= 1 and len(own[0] | own[1]) > 4
    assert sorted(r["slot"] for r in rows.collect()) == list(range(rows.count())) and spark.conf.get(name) == was
    monkeypatch.undo()
    before |= left()  # of the reading above
    token_shards.write_shards(docs(spark, [prose(i, 400) for i in range(40)]), BYTE, "k", length=16, per_shard=64)
    end = time.time() + 10
    while left() - before and time.time() < end:
        time.sleep(0.2)
    assert not left() - before


def test_encoders_against_the_library():
    """White space of all kinds, marks, letters of other scripts, special strings."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(6)
    bits = [" ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "\x1c", "\x85", "\u00a0", "\u3000", "\u200b", "the", "The", "na\u00efve", "don't", "we'll", "x1", "42", ",", ".", "!?", "\u6f22", "\u0130s", "\u00df", "<|endoftext|>", "e\u0301", "\U0001f600"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(4000)] + [" ".join(rng.choice(["a", "bc,", "D\ne", "f.\nG"], 9)) for _ in range(50)]
    for path, encode in ((BYTE, lambda x: np.frombuffer(token_shards.encoder_of(BYTE, 4).encode(x), "<u4")), (WORD, lambda x: np.frombuffer(packing.encoder_of(WORD).encode([x])[0], "<u4"))):
        t = Tokenizer.from_file(path)
        assert [x for x in texts if encode(x).tolist() != t.encode(x, add_special_tokens=False).ids] == []


def latin_texts():
    """Every character that the merging at once takes, beside letters, numbers, marks and blanks, and mixtures."""
    rng = np.random.default_rng(8)
    each = [t.replace("?", chr(c)) for c in range(0x260) for t in ("?", "a?", "?b ??1", "'? don't'S ?y", "x ? y", "?\n?")]
    bits = ["the", "THE", " ", " ", "\n", "'s", "'T", "'", "7", "\xbd", "\xb2", ",", "...", "\xad", "\xdf", "\u023a", "\u0149", "\xaa", "zq", "ing"]
    return each + ["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(4000)] + [prose(1, 300), "x" * 30_000, "<|endoftext|>", "a \x01 b"]


def test_words_merged_at_once_against_the_library(tmp_path):
    """Latin texts take one call and leave nothing behind; a file that cuts words otherwise goes by the library."""
    from tokenizers import Tokenizer

    from tastemill.llm import bpe

    texts, plain = latin_texts(), [prose(i, 50) + ", d\u00e9j\u00e0 VU!" for i in range(20)]
    spec = json.loads(Path(WORD).read_text())
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    for path in (WORD, str(other)):
        encoder, library = packing.WordEncoder(path), Tokenizer.from_file(path)
        known = len(encoder.words)
        assert [encoder.at_once(t) is not None for t in plain] == [path == WORD] * len(plain)
        encoder.encode(plain)
        assert (len(encoder.words) == known) == (path == WORD)
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert [t for t, x in zip(texts, got) if x != library.encode(t, add_special_tokens=False).ids] == []
    vocab = spec["model"]["vocab"]
    first, last = ("".join(spec["model"]["merges"][k]) for k in (0, -1))
    vocab[first], vocab[last] = vocab[last], vocab[first]  # ids no longer in the order of merges
    assert bpe.ranks_of(spec) is None


def test_texts_merged_at_once_against_the_library(tmp_path):
    """Of either width; a file that changes texts first goes by words, as do texts with other white space."""
    from tokenizers import Tokenizer

    texts, plain = latin_texts(), [prose(i, 50) + ",\nd\u00e9j\u00e0 VU! don't" for i in range(20)]
    spec = json.loads(Path(BYTE).read_text())
    spec["normalizer"] = {"type": "NFC"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    for path, width in ((BYTE, 2), (BYTE, 4), (str(other), 2)):
        encoder, library = token_shards.ChunkEncoder(path, width), Tokenizer.from_file(path)
        known = len(encoder.words)
        assert [len(encoder.encode(t)) // width for t in plain] == [len(library.encode(t, add_special_tokens=False).ids) for t in plain]
        assert (len(encoder.words) == known) == (path == BYTE)
        got = [np.frombuffer(encoder.encode(t), f"<u{width}").tolist() for t in texts]
        assert [t for t, x in zip(texts, got) if x != library.encode(t, add_special_tokens=False).ids] == []


# 7: prediction by partial matching


def slow_scores(train, texts, order=ppm.ORDER):
    seen = {}
    for x in train:
        y = bytes(order) + x
        for i in range(order, len(y) + 1):
            s = y[i] if i < len(y) else 256
            for k in range(order + 1):
                m = seen.setdefault(y[i - k : i], {})
                m[s] = m.get(s, 0) + 1
    out = []
    for x in texts:
        y, total = bytes(order) + x, 0.0
        for i in range(order, len(y) + 1):
            s, excluded = (y[i] if i < len(y) else 256), set()
            for k in range(order, -1, -1):
                left = {a: b for a, b in seen.get(y[i - k : i], {}).items() if a not in excluded}
                if not left:
                    continue
                n, q = sum(left.values()), len(left)
                if s in left:
                    total += math.log10(left[s] / (n + q))
                    break
                total += math.log10(q / (n + q))
                excluded |= set(left)
            else:
                total -= math.log10(257 - len(excluded))
        out.append(total)
    return out


def test_scores(spark, some, empty):
    held = language_id.training_fold(F.col("doc_id"), 7) == 2
    low = [(t or "").encode().lower() for t in TEXTS]
    train = [x for i, x in enumerate(low) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for x in train for w in x.split())
    c[None] = len(train)
    n, v = sum(c.values()), len(c)
    slow = slow_scores(train, low)
    for options in ({}, {"slice_nodes": 60, "batch_bytes": 3000}):
        got = {r["doc_id"]: r for r in ppm.score_documents(some, held, **options).collect()}
        assert len(got) == len(TEXTS)
        for i, x in enumerate(low):
            w = [*x.split(), None]
            assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(c[t] > 0 for t in w), n)
            assert math.isclose(got[i]["base_score"], sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w), rel_tol=1e-9)
            assert math.isclose(got[i]["score"], slow[i], rel_tol=1e-5)
    assert ppm.score_documents(empty, held).count() == 0
    one = ppm.score_documents(some, F.lit(True)).where("doc_id = 3").first()
    assert math.isclose(one["score"], -4 * math.log10(257)) and one["train_tokens"] == 0


def test_windows_change_nothing(monkeypatch):
    text = prose(9, 3000).encode()

    def read():
        found = list(ppm.blocks([text]))
        keys = [np.concatenate(x).tolist() for x in zip(*(b.keys()[1:] for b in found))]
        return len(found), keys, sorted(np.concatenate([b.all_words()[1] for b in found]).tolist())

    whole = read()
    monkeypatch.setattr(ppm, "BLOCK", 500)
    parts = read()
    assert parts[1:] == whole[1:] and parts[0] > 10 and len(whole[2]) == 3001


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for x in (np.sort(rng.integers(0, 1 << 49, 1000)), rng.integers(-(1 << 62), 1 << 62, 77), np.zeros(0, np.int64), np.array([-(1 << 63), (1 << 63) - 1])):
        assert ppm.unpacked(ppm.packed(x), len(x)).tolist() == x.tolist()


def test_hot_suffixes_are_split(spark):
    """No slice has more than twice its nodes beside the split suffixes' contexts, although one last byte has most nodes."""
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdefgh"), 4000)) + "".join(x + "e" for x in rng.choice(list("abcdefgh"), 4000))
    rows = docs(spark, [text, prose(2, 300)]).select("doc_id", F.lit(False).alias("held_out"), F.col("text").cast("binary").alias("text"))
    scratch = Scratch(spark, "test")
    batches = ppm.batches_of(rows, 1 << 20, scratch)
    model = ppm.build_model(batches, scratch, slice_nodes=500)
    sizes = {r["slice"]: r["count"] for r in spark.read.parquet(f"{model['path']}/nodes").groupBy("slice").count().collect()}
    split = 1 + sum(len(x) for _, x, _ in model["leaves"]) // 2
    assert len(model["leaves"]) > 1 and max(n for k, n in sizes.items() if k >= 0) <= 1000 and sizes[-1] <= 257 * split


# 8: n-gram join


def slow_components(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = label[i], label[j]
                label = [min(x, y) if k in (x, y) else k for k in label]
    return [(len(s), k) for s, k in zip(sets, label)]


def near_texts(seed=0):
    """Groups of near copies with growing edits, a passage that many share, copies, short and empty texts."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = list(rng.choice(vocabulary, 20))
    out = [None, "", "One two", "one two", "one two three four", "ONE two three four"]
    for g in range(12):
        words = list(rng.choice(vocabulary, 80))
        for c in range(5):
            own = list(words)
            for k in range(c * (1 + g % 3)):
                own[int(rng.integers(len(own)))] = f"x{g}-{c}-{k}"
            out.append(" ".join(own))
        out.append(" ".join([*rng.choice(vocabulary, 40), *passage]))
    chain = list(rng.choice(vocabulary, 60))
    for k in range(15):
        chain[3 * k] = f"c{k}"
        out.append(" ".join(chain))
    return [*out, out[10], out[10], out[30]]


@pytest.mark.parametrize("options", [{}, {"block_rows": 3, "bucket_columns": 50}])
def test_near_components(spark, options):
    texts = near_texts()
    for n, percent in ((4, 85), (5, 80)) if not options else ((4, 85),):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_components(docs(spark, texts), n, percent, **options).collect()}
        assert [got[i] for i in range(len(texts))] == slow_components(texts, n, percent)


def test_near_drop_and_empty(spark, empty):
    texts = near_texts(3)
    left = ngram_join.drop_near_duplicates(docs(spark, texts), 4, 85)
    assert left.columns == ODD.replace(" string", "").replace(" long", "").replace(" int", "").split(", ")
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i, (_, k) in enumerate(slow_components(texts, 4, 85)) if i == k]
    assert ngram_join.near_components(empty).count() == 0 and ngram_join.drop_near_duplicates(empty).count() == 0


def test_rows_left_against_counting(spark, monkeypatch):
    """In chunks of a few rows and buckets of a few columns; nothing is lost, and only rows with too few go."""
    sets = ngram_join.shingle_sets([(t or "").lower().encode() for t in near_texts(5)], 4)
    sets = list({s.tobytes(): s for s in sets if len(s)}.values())
    least = [max(1, ngram_join.need(len(s), 85) // 10) for s in sets]
    part = [s[: len(s) - ngram_join.need(len(s), 85) + max(1, len(s) // 10)] for s in sets]
    often = Counter(x for s in part for x in s.tolist())
    want = {ngram_join.class_of(s) for s, p, k in zip(sets, part, least) if sum(often[x] > 1 for x in p.tolist()) >= k}
    rows = [(ngram_join.class_of(s), k, p.tobytes()) for s, p, k in zip(sets, part, least)]
    df = spark.createDataFrame(rows, "cls long, least long, prefix binary")
    monkeypatch.setattr(ngram_join, "CHUNK_ROWS", 6)
    for bucket in (1 << 30, 40):
        assert {r["cls"] for r in ngram_join.shared_prefixes(df, sum(map(len, part)), bucket).collect()} == want


def test_null_and_repeated_ids(spark):
    """Rows of one id are told apart by their texts; null ids take part, and a component without another id has none."""
    a, b = prose(11, 60), prose(12, 60)
    rows = [(None, a), (1, a + " x"), (1, b), (2, b + " y"), (None, prose(13, 60)), (None, prose(13, 60)), (3, None), (3, "")]
    got = ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert Counter((r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in got) == Counter([(None, True, 1), (1, True, 1), (1, True, 1), (2, True, 1), (None, True, None), (None, True, None), (3, False, 3), (3, False, 3)])


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, k) for k in range(51, 90)] + [(7, 7), (100, 101), (101, 100)]
    rng = np.random.default_rng(4)
    more = [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (260, 2))]
    label = {x: x for e in more for x in e}
    for a, b in more:
        x, y = label[a], label[b]
        label = {i: min(x, y) if k in (x, y) else k for i, k in label.items()}
    label = {x: k for x, k in label.items() if any(x in e and e[0] != e[1] for e in more)}
    table, scratch = spark.createDataFrame(edges + more, "u long, v long"), Scratch(spark, "test")
    for most in (0, 1_000_000):
        got = {r["node"]: r["component"] for r in components.components(table, scratch, most).collect()}
        assert components.components(table.limit(0), scratch, most).count() == 0
        assert {k: v for k, v in got.items() if k >= 1000} == label
        got = {k: v for k, v in got.items() if k < 1000}
        assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(50, 90), 50), 100: 100, 101: 100}


# 9: mixing


def slow_mix(rows):
    sizes = defaultdict(int)
    for _, s, z in rows:
        sizes[s] += z
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, budget, target = set(order), 1.5 * sum(sizes.values()), {}
    while left:
        total = sum(weight[s] for s in left)
        over = [s for s in left if budget * weight[s] / total > 2 * sizes[s]]
        if not over:
            target |= {s: budget * weight[s] / total for s in left}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
            left.discard(s)
    return sizes, target


def test_mix(spark, empty):
    rng = np.random.default_rng(4)
    rows = [(i, (None, "b", "a", "é", "Z")[i % 5 if i % 3 else 2], int(rng.integers(0, 50))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").cache()
    got = mixing.mix_plan(df).collect()
    sizes, target = slow_mix(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == 900 and all(taken[s] == math.floor(target[s]) for s in sizes)
    assert sorted(map(tuple, mixing.mix_plan(df.repartition(7)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix_plan(empty.select("doc_id", "source", F.lit(1).cast("long").alias("size"))).count() == 0 and mixing.apply_mix(empty).count() == 0


def test_mixed_corpus(spark):
    texts = [prose(i, 5 + i % 30) for i in range(120)] + [None, ""]
    df = docs(spark, texts, sources=("a", "b", None, "a", "a"))
    rows = [(i, ("a", "b", None, "a", "a")[i % 5], len((t or "").split())) for i, t in enumerate(texts)]
    sizes, target = slow_mix(rows)
    words = defaultdict(int)
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert (texts[r["doc_id"]] or "").startswith(r["text"])
        words[r["source"]] += len(r["text"].split())
    assert all(words[s] == math.floor(target[s]) for s in sizes)


def test_mix_keeps_columns_of_inner_names(spark):
    rows = [(i, "ab"[i % 2], 1 + i % 7, f"k{i}", -i, i * 2, 0.5) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, key string, src int, range long, target double")
    got = mixing.mix_plan(df).collect()
    assert sorted((r["doc_id"], r["key"], r["src"], r["range"]) for r in got) == sorted((r[0], r[3], r[4], r[5]) for r in rows)
    plain = mixing.mix_plan(df.select("doc_id", "source", "size")).collect()
    assert sorted((r["doc_id"], r["target"], r["taken"]) for r in got) == sorted((r["doc_id"], r["target"], r["taken"]) for r in plain)


def test_ties_at_the_cut(spark):
    df = spark.createDataFrame([(1, "a", 10)] * 30 + [(2, "b", 5)], "doc_id long, source string, size long")
    got = mixing.mix_plan(df).where("source = 'a'").agg(F.sum("taken"), F.first("target")).first()
    assert got[1] - 31 <= got[0] <= got[1]


# 10: URLs

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/*/x", "block")]
URLS = [None, "", "no scheme/en/", "http://A.Example.COM/en/7", "http://example.com/en/75?q#f", "http://notexample.com/en/7", "x://com/en/", "http://com?/en/", "s://a.net/de/8", "s://a.example.net/de/8/", "s://example.net/de/9",
        "http://org/es/a/b/x", "http://org/es/x", "http://a.org/es//x?y", "http://é.com/en/\n", "http://u@b.com:80/en/", "a://b://c.com/en/"]


def slow_judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and re.match(re.escape(r[1]).replace(r"\*", "(?s:.*)"), path)]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_urls(spark):
    df = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, host int, best string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(df, RULES).collect()}
    assert [got[i] for i in range(len(URLS) * 2)] == [slow_judge(u) for u in URLS * 2]
    assert url_filter.judge_urls(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(df, [], default="block").collect()} == {"block"}
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(df, RULES, max_rules=2).collect()}  # three indexes
    assert [got[i] for i in range(len(URLS) * 2)] == [slow_judge(u) for u in URLS * 2]


def test_urls_without_tokens_and_long_ones(spark):
    """Rules that no complete token tells apart run on every URL; URLs of a hundred thousand characters."""
    rules = [("", "/en", "block"), ("com", "/", "allow"), ("", "/*zz", "block")]
    urls = ["http://a.com/en", "http://a.net/english", "http://b.org/x/zz", "http://b.org/" + "ab/" * 40_000 + "zz", "x://" + "h" * 100_000 + "/en", "x:///en", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")

    def slow(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and re.match(re.escape(r[1]).replace(r"\*", "(?s:.*)"), path)]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        return best and best[0] + best[1], best[2] if best else "allow"

    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, rules).collect()}
    assert [got[i] for i in range(len(urls))] == [slow(u) for u in urls]
