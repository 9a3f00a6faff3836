"""Small brute-force checks, and the defined results for nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillforge.llm import blocks, bpe, brown_lm, components, language, licences, media, mixing, ngram_join, quality_classifier, quality_rules, registry, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, block long, path string"


def rows():
    base = " ".join(f"word{i % 37}x{i}" for i in range(120)) + "."
    near = base.replace("word5x5 ", "other ")
    odd = ["", None, "a", "\n\n \t", "É ñ 👍🏽 \x1c\x85", "x " * 3000, base, base, near, "word " * 60000, "Released under the MIT License.\n" + base, "1 2 3"]
    docs = [(i, t, ["en", "de", None][i % 3], ["s1", "s1", "s0", None][i % 4], None, 0.0, 1, "p") for i, t in enumerate(odd)]
    docs += [(100 + i, " ".join(f"{'aeiou'[i % 5]}w{(i * j) % 50}" for j in range(80)), "en" if i % 2 else "fr", "s1", 5, 1.0, 2, None) for i in range(60)]
    return [*docs, docs[6], (None, base, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(100 + i, i % 2, (i + 1) % 2) for i in range(60)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_every_row_has_a_result_and_empty_tables_do(spark, docs, empty, name):
    query = registry.queries()[name]
    got = query(spark, docs)
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r[0]) for r in rows())
    assert query(spark, empty).count() == 0


def test_quality_rules(spark, docs, monkeypatch):
    def brute(t):
        t = t or ""
        w = WORD.findall(t)
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)

    clashing = spark.read.parquet(f"{docs}/documents.parquet").withColumns({c: F.lit("own") for c in ("kept", "__text_0", "__words_0", "__Order_0", "N_Words")})
    assert quality_rules.measure(clashing).where("kept and n_words > 50").select("__text_0", "kept").count() > 0  # the filter stays above the statistics
    assert quality_rules.keep(clashing).columns == clashing.columns and quality_rules.keep(clashing).count() == quality_rules.measure(clashing).where("kept").count()
    sorted_ = quality_rules.measure(spark.read.parquet(f"{docs}/documents.parquet").where("length(text) < 9000")).collect() if monkeypatch.setattr(quality_rules._Windows, "collide", lambda self: F.lit(True)) is None else []
    monkeypatch.undo()
    for r in quality_rules.measure(clashing).collect() + sorted_:  # the second as if all hashes collided
        n = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and (not r.kept or not r.base_failed)


def test_clean_text_drops_the_failing_lines(spark):
    good = "A proper sentence with some more words than the least that a line needs."
    texts = [f"Home | About | Contact | Login\n{good}\n\n{good}\nHome", good, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.c for r in df.orderBy("doc_id").select(quality_rules.clean_text(F.col("text")).alias("c")).collect()]
    assert got == [f"{good}\n\n{good}", good, "", None]
    lost = {r.doc_id: r.n_lost_words for r in quality_rules.measure(df).collect()}
    assert all(lost[i] == len(WORD.findall(t or "")) - len(WORD.findall(c or "")) for i, (t, c) in enumerate(zip(texts, got, strict=True)))
    text = "Home\n" + " ".join(f"w{i}" for i in range(60)) + "."
    assert [r.text for r in quality_rules.keep(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()] == [text]  # the stage keeps the original


def test_bpe_equals_the_library(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    e = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.load_ranks(bpe.default_vocabulary()), special_tokens={})
    df = spark.read.parquet(f"{docs}/documents.parquet").where("length(text) < 20000 or text is null")
    odd = [(1000, "x\u00b2\u00bd\u0660 \u2163 a\u0301b \x1c\x85 \u00a0 \u3000 don't 'll _a_ \U0001f44d\U0001f3fd\u200d \t\n  end "), (1001, "aaaa aaaaaaa aaaaaaaaaaaaaaa " * 20), (1002, "\u0130\u0131\u01c5\u02b0\u0250 \u00aa\u00ba")]
    df = df.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    want = []
    for r in df.collect():
        ids = e.encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    for block, replay in ((blocks.BLOCK_BYTES, bpe.REPLAY_BYTES), (500, 50)):
        got = bpe.encode_documents(bpe.table(spark, docs, "documents").where("length(text) < 20000 or text is null").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")), block_bytes=block, replay_bytes=replay)
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == sorted(want)
    back = bpe.encode(df.where("doc_id >= 100")).select("doc_id", bpe.decode_column(F.col("ids")).alias("back")).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    assert back and all(bytes(r.back) == texts[r.doc_id].encode() for r in back)


def test_packed_numbers():
    for x in ([], [0], [0, 0, 255], [256, 1], [2**32 - 1, 0, 70000]):
        assert blocks.unpack(blocks.pack(np.array(x, np.uint32))).tolist() == x
    words = [b"", b"a", "\u00e9\x00".encode(), b"a" * 1000]
    assert blocks.unpack_bytes(*blocks.pack_bytes(words)) == words


def test_join_equals_brute_force(spark, docs):
    found = [(r.doc_id, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := WORD.findall(r.text or "")) else None) for r in spark.read.parquet(f"{docs}/documents.parquet").collect()]
    links = [sum(1 for j, (_, b) in enumerate(found) if i != j and a and b and len(a & b) >= 0.8 * len(a | b)) for i, (_, a) in enumerate(found)]
    for limit, block, shingles, few in ((200, 512, 1_000_000, 4_000_000), (2, 2, 1_000_000, 0), (200, 512, 200, 0)):  # the second takes every deep path
        got = ngram_join.join_documents(spark.read.parquet(f"{docs}/documents.parquet"), limit=limit, block=block, block_shingles=shingles, broadcast_sets=few).collect()
        assert sorted((str(r.doc_id), r.n_links) for r in got) == sorted((str(i), n) for (i, _), n in zip(found, links, strict=True))


def test_join_of_large_groups_by_their_core(spark):
    rng = random.Random(5)
    texts = []
    for base in ([f"a{i}" for i in range(150)], [f"b{i}" for i in range(400)]):
        for edits in [0, 0, 1, 1, 1, 2, 2, 2, 2, 3, 3, 4, 5, 7, 9] * 4:
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"z{rng.randrange(40)}"
            texts.append(" ".join(words[: len(words) - rng.choice((0, 0, 0, 12))]))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(str.split, texts)]
    near = [[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
    links = [sum(row) - 1 for row in near]
    assert len(set(links)) > 10  # some are within the limit of all in their group, some of a part, some of few
    least = list(range(len(sets)))
    for _ in sets:
        least = [min(x for x, linked in zip(least, row, strict=True) if linked) for row in near]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block, shingles in ((512, 1_000_000), (8, 1_000_000), (512, 2000), (1, 1_000_000)):
        got = sorted(map(tuple, ngram_join.join_documents(docs, block=block, block_shingles=shingles).select("doc_id", "class_id", "n_links").collect()))
        assert got == [(i, least[i], n) for i, n in enumerate(links)]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, docs, empty, name):
    for folder in (docs, empty):
        with duckdb.connect() as db:
            db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
            found = db.sql(registry.oracle_sql()[name])
            columns, expected = found.columns, found.fetchall()
        got = registry.queries()[name](spark, folder)
        assert sorted(got.columns) == sorted(columns)
        assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, expected))


def test_components_in_rounds(spark):
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, 3), (100, 200)]
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(8), edges_per_task=5)
    assert {r.node: r.component for r in got.collect()} == {**{i: i // 10 * 10 for i in range(40)}, 100: 0, 200: 0}


def test_components_of_a_block():
    rng = random.Random(3)
    for n, m in ((1, 0), (5, 4), (300, 200), (2000, 1900), (500, 3000)):
        edges, union = [(rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(m)] + [(i, i + 1) for i in range(0, -n // 2, -1)], components.UnionFind()
        for u, v in edges:
            union.join(u, v)
        nodes, least = components.least_of_component(*(np.array([e[i] for e in edges], np.int64) for i in (0, 1)))
        assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == {x: union.find(x) for x in union.parent}


def test_mixing(spark):
    assert mixing.targets([100, 10, 90], [5, 2, 1], 200) == pytest.approx([200 - 30 - (200 - 30) / 6, 30, (200 - 30) / 6])
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(6000)], "doc_id long, text string, source string")
    runs = [sorted(map(tuple, mixing.mix(df.repartition(n), group_rows=200, fan_in=3).select("doc_id", "taken").collect())) for n in (2, 5)]
    assert runs[0] == runs[1]
    for r in mixing.mix(df, group_rows=200, fan_in=3).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("taken") / F.col("size")).alias("m")).collect():
        assert abs(r.t - r.g) <= 7 and r.m <= 3


def test_repeated_rows_are_told_apart(spark):
    df = spark.createDataFrame([(7, "a b c", "s")] * 3000 + [(None, None, None)] * 500 + [(i, "d e", "s") for i in range(500)], "doc_id long, text string, source string").repartition(6)
    rows = mixing.checkpointed(df.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), F.spark_partition_id().alias("part")))
    found = collections.defaultdict(list)
    for r in mixing.ordinals(rows).collect():
        found[r.doc_id, r.row_hash].append(r.ordinal)
    assert len(found) == 502 and all(sorted(x) == list(range(len(x))) for x in found.values())
    out = mixing.mix(df, group_rows=100).collect()
    assert len(out) == 4000 and all(r.copies <= 3 for r in out)
    of = [r for r in out if r.source == "s"]
    assert abs(sum(r.taken for r in of) - of[0].target) <= 3


def test_media_round_trip(spark, docs):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{docs}/documents.parquet").collect()}
    for r in registry.queries()["op9_media_columns"](spark, docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert r.verified and (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert len(r.media_sha256) == 64 and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-576:]) and b"".join(media.chunks_of(payload)) == payload


def test_media_payload_columns_of_odd_rows(spark, tmp_path):
    texts = [None, "", "a", "x" * 575, "x" * 576, "x" * 577, "a" * 544 + "b" * 32, "\u00e9" * 288, "\0" * 10, "\U0001d11e" * 1000, "ab" * 30000, "line\r\n"]
    rows = [*enumerate(texts), (None, "no id"), (None, None), (5, "again"), (5, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def want(text):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])

    got = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in registry.queries()["op9_media_columns"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(((i, *want(x)) for i, x in rows), key=repr)


def test_media_of_common_chunks(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passage = " ".join(word() for _ in range(9000))
    texts = [f"{word()} {passage} {word()}" for _ in range(40)] + [word() for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    lists = media.chunk_lists(docs, 3)
    assert 0 < lists.where("common").select("digest").distinct().count() < lists.select("digest").distinct().count()
    whole, parted, all_parted = (sorted(map(repr, media.store_and_read(docs, common).collect())) for common in (1000, 3, 0))
    assert whole == parted == all_parted and len(whole) == 60 and "verified=False" not in "".join(whole)


def test_brown_lm(spark, docs):
    data = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in spark.read.parquet(f"{docs}/documents.parquet").collect()]
    learn = [w for i, w in data if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(x for w in learn for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted((len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)) for _, w in data)
    got = brown_lm.score_documents(spark.read.parquet(f"{docs}/documents.parquet"), block_tokens=5000).collect()
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want and {r.train_tokens for r in got} == {n}
    # brute force of score: classes from the model, class bigrams and emissions counted anew
    table_ = spark.read.parquet(f"{docs}/documents.parquet")
    rows_ = [(r.doc_id, brown_lm.words_of(r.text) + [b""]) for r in table_.collect()]
    learn = table_.where("doc_id is not null and crc32(cast(doc_id as string)) % 10 <> 0")
    model = brown_lm.fit(learn.select("text"))
    rare = {bytes(r.word): r.cls for r in brown_lm.assign(learn.select("text"), spark.sparkContext.broadcast(model)).collect()}
    cls = lambda w: int(model.cls[model.units.core[w]]) if w in model.units.core else rare.get(w, int(model.cls[model.units.of(w)]))
    k, n_pairs, emitted, distinct = brown_lm.CLASSES, collections.Counter(), collections.Counter(), collections.Counter(cls(w) for w in c)
    for w in learn_rows(rows_):
        for before, x in zip([b"", *w[:-1]], w, strict=True):
            n_pairs[cls(before), cls(x)] += 1
            emitted[cls(x)] += 1
    total = sum(emitted.values())

    def naive(w):
        out = 0.0
        for before, x in zip([b"", *w[:-1]], w, strict=True):
            a, b = cls(before), cls(x)
            row = [n_pairs[a, j] for j in range(k)]
            followers = max(1, sum(v > 0 for v in row))
            prior = (emitted[b] + 0.5) / (total + 0.5 * k)
            out += math.log10((row[b] + followers * prior) / (sum(row) + followers)) + math.log10((c[x] + 0.1) / (emitted[b] + 0.1 * (distinct[b] + 1)))
        return out

    small = [(i, w) for i, w in rows_ if len(w) < 500]
    assert sorted(round(r.score, 3) for r in got if r.n_tokens < 500) == pytest.approx(sorted(round(naive(w), 3) for _, w in small), abs=0.01)


def learn_rows(rows_):
    return [w for i, w in rows_ if i is not None and zlib.crc32(str(i).encode()) % 10]


def test_brown_lm_clusters_rare_words_by_their_neighbours(spark):
    # of each kind one word is frequent and 3,200 are rare, whose last letters are alike, so that a signature can't tell the kinds apart
    texts = [" ".join(f"the {w} {('runs', 'tall')[k]} {('fast', 'tree')[k]}" for j in range(8) for k in (0, 1) for w in (f"{'ab'[k]}{i}-{j}zz", ("cat", "big")[k])) for i in range(400)]
    learn = spark.createDataFrame([(t,) for t in texts], "text string")
    model = brown_lm.fit(learn, classes=8)
    got = {bytes(r.word): (r.n, r.cls) for r in brown_lm.assign(learn, spark.sparkContext.broadcast(model)).collect()}
    want = collections.Counter(w for t in texts for w in t.encode().split())
    assert {w: x[0] for w, x in got.items()} | {w: int(model.core_counts[i]) for w, i in model.units.core.items()} == want | {b"": 400}
    n = sum(want.values()) + 400
    assert set(model.units.core) == {w for w, k in want.items() if k * brown_lm.CORE >= n} | {b""} and model.n_tokens == n
    odd = [b"", b"a", b".", b"....", b"ab....", b"word,", b"(word).", "\u00e9t\u00e9.".encode(), b"\xff\xfe", *got]
    assert model.units.of_all(odd).tolist() == [model.units.of(w) for w in odd]
    # brute force: every word by its own neighbours
    near = collections.defaultdict(lambda: np.zeros(16))
    for t in texts:
        w = [b"", *t.encode().split(), b""]
        c = [model.cls[model.units.of(x)] for x in w]
        for i in range(1, len(w) - 1):
            near[w[i]][c[i - 1]] += 1
            near[w[i]][8 + c[i + 1]] += 1
    assert len(got) == 6400 and all(x[1] == np.argmax(np.round(near[w] @ model.likely, 9)) for w, x in got.items())
    for classes in ({x[1] for w, x in got.items() if w.startswith(k)} for k in (b"a", b"b")):
        assert len(classes) == 1
    assert got[b"a0-0zz"][1] != got[b"b0-0zz"][1]


def test_brown_lm_shuffles_less_than_the_texts(spark, tmp_path):
    """Texts are cut into blocks of numbers once: neither they nor a row for each word of a block goes through a shuffle."""
    rng = random.Random(7)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 60_000}" for _ in range(2000)) for _ in range(300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(4).write.parquet(str(tmp_path / "t"))
    before = shuffled(spark)
    assert brown_lm.score_documents(spark.read.parquet(str(tmp_path / "t"))).count() == 300
    assert shuffled(spark) - before < 0.6 * sum(map(len, texts))


def shuffled(spark):
    """Bytes that the session's stages have written to shuffles."""
    array = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, array, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("laid_out", [3, 16_384])
def test_brown_lm_slices_answer_every_sender(monkeypatch, laid_out):
    """Several blocks that share words; held-out texts teach nothing, and their new words have their signatures' classes."""
    monkeypatch.setattr(brown_lm, "LAID_OUT", laid_out)
    rng = np.random.default_rng(3)
    units = brown_lm.Units({b"": 0, b"the": 1})
    model = brown_lm.BrownModel(units, np.array([9, 9]), rng.integers(0, 4, units.size), rng.normal(size=(8, 4)), 0)
    texts = [[" ".join(f"w{x}" if x % 5 else "the" for x in rng.integers(0, 40 + 20 * b, 30)) for _ in range(6)] + [None] for b in range(3)]
    out = [False, True, False, False, True, False, False]
    sent = [brown_lm._block_rows(b, list(range(7)), out, t, model, 4) for b, t in enumerate(texts)]
    rows = sorted((r for x in sent for r in x.to_pylist() if r["slice"] != blocks.TEXTS), key=lambda r: (r["slice"], r["block"]))
    near, seen = collections.defaultdict(lambda: np.zeros(8)), [set(), set(), set()]
    for b, t in enumerate(texts):
        for text, held in zip(t, out, strict=True):
            w = [b"", *brown_lm.words_of(text), b""]
            c = [int(model.cls[units.of(x)]) for x in w]
            for i in range(1, len(w) - 1):
                if w[i] != b"the":
                    seen[b].add(w[i])
                    near[w[i]] += 0 if held else np.eye(8)[c[i - 1]] + np.eye(8)[4 + c[i + 1]]
    got, told = {}, [set(), set(), set()]
    for _, words, n, cls, senders in brown_lm._slices([pa.RecordBatch.from_pylist([r], schema=sent[0].schema) for r in rows], model):
        got |= dict(zip(words, zip(n.tolist(), cls.tolist(), strict=True), strict=True))
        for b, own in senders:
            told[b] |= {words[i] for i in own}
    assert told == seen
    assert got == {w: (int(x.sum()) // 2, int(np.argmax(np.round(x @ model.likely, 9))) if x.any() else int(model.cls[units.of(w)])) for w, x in near.items()}
    assert any(not x.any() for x in near.values())


def test_licences_inherit_from_the_nearest_directory(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c/x.py", "code"), ("a/y.py", "This work is licensed under the GNU General Public License, version 3.\ncode"), ("a/z.py", None), ("q.py", "code")]
    got = {r.path: (r.licence, r.origin, r.licence_dir) for r in licences.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["a/b/c/x.py"] == ("Apache-2.0", "inherited", "a/b") and got["a/z.py"] == ("MIT", "inherited", "a")
    assert got["a/y.py"] == ("GPL-3.0", "own", None) and got["q.py"] == (None, "none", None)


def test_licences_of_ordinary_headers(spark):
    long = " ".join(f"word{i}" for i in range(40))
    files = {
        "a.js": ("// SPDX-License-Identifier: MIT\ncode", "MIT"),
        "b.py": ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        "c.c": ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0"),
        "d.c": ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) */", "(MIT OR Apache-2.0)"),
        "e.py": ("Copyright (c) 2019 Jane Example and contributors\nReleased under the MIT License.", "MIT"),
        "f.py": (f"{long} Released under the MIT License. {long}", "MIT"),
        "g.py": (f"{long} released under the MIT License {long}", "MIT"),
        "h.py": ("# Copyright 2020 A. All rights reserved.\n# Licensed under the Apache License,\n# Version 2.0", "Apache-2.0"),
        "i.py": ("Copyright (c) 2020 A. All rights reserved.", "Proprietary"),
        "j.py": ("The driver needs a licence to drive.", None),
    }
    got = {r.path: r.licence for r in licences.scan(spark.createDataFrame([(k, v[0]) for k, v in files.items()], "path string, text string")).collect()}
    assert got == {k: v[1] for k, v in files.items()}


def test_licences_are_told_from_their_kin():
    m = licences.Matcher(licences.TEMPLATES, licences.THRESHOLD, licences.full_texts())
    of = lambda text, path="x.py": (m.best(path, text) or (None,))[0]
    for licence, text in licences.full_texts().items():
        assert of("Copyright (c) 2020 Jane Example\n\n" + text, "a/LICENSE") == licence
    work = "This work is licensed under {}."
    for name, licence in {
        "the GNU General Public License, version 2": "GPL-2.0", "the GNU General Public License, version 3": "GPL-3.0", "the GNU General Public License, version 4": "unknown",
        "the GNU Lesser General Public License, version 2.1": "LGPL-2.1", "the GNU Lesser General Public License, version 3": "LGPL-3.0", "the GNU Affero General Public License, version 3": "AGPL-3.0",
        "a Creative Commons Attribution 4.0 International License": "CC-BY-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
        "the Apache License, Version 2.0": "Apache-2.0", "the Apache License, Version 1.1": "unknown", "the ISC License": "ISC", "the Eclipse Public License 2.0": "EPL-2.0",
    }.items():
        assert of(work.format(name)) == licence, name
    gpl = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version."
    assert of(gpl) == "GPL-2.0" and of(gpl.replace("General", "Lesser General").replace("version 2 ", "version 2.1 ")) == "LGPL-2.1" and of(gpl.replace("General", "Affero General").replace("version 2", "version 3")) == "AGPL-3.0"
    assert of("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n" + licences.full_texts()["GPL-3.0"].split("\n", 3)[3], "LICENSE") == "AGPL-3.0"
    opening = licences.full_texts()["BSD-2-Clause"].split("1.")[0]
    assert of(opening) == "unknown" and of(licences.full_texts()["BSD-2-Clause"]) == "BSD-2-Clause" and of(licences.full_texts()["BSD-3-Clause"]) == "BSD-3-Clause"
    assert of("Some words before. All rights reserved. And of it\nsome after") == of("one two\nAll rights reserved.") == "Proprietary" and of("See the LICENSE file for details.") is None
    assert of("This is free and unencumbered software released into the public domain.") == "Unlicense" and of("A driver needs a licence.") is None


def test_models_learn_on_held_out_rows():
    docs = [("la maison est grande et le chat dort " * 3, "fr") if i % 2 else ("the house is large and the cat sleeps " * 3, "en") for i in range(40)]
    model = language.fit([d[0] for d in docs], [d[1] for d in docs])
    assert model.predict(["the cat is in the house", "le chat est dans la maison", "123", None])[0] == ["en", "fr", "und", "und"]
    texts = [" ".join(f"w{(i * 7 + j * 3) % 90}" for j in range(30)) + (" vileword!" if i % 3 == 0 else "") for i in range(240)]
    tox = toxicity.fit(texts, [int(i % 3 == 0) for i in range(240)])
    s = tox.score(["w1 w2 Vileword w4", "w1 w2 w3 w4", "", None])
    assert s[0] >= 0.5 > max(s[1:])
    good, bad = [(f"A clean line number {i}, with words.", "en", "s") for i in range(60)], [(f"JUNK$$$ {i} ### |||", "en", "t") for i in range(60)]
    q = quality_classifier.co_train(good[:40] + bad[:40], np.array([1.0] * 40 + [0.0] * 40), good[40:50] + bad[40:50])
    x = q.score([r[0] for r in good[50:] + bad[50:]], ["en"] * 20, ["s"] * 10 + ["t"] * 10)[:, 0]
    assert (x[:10] > 0.5).all() and (x[10:] < 0.5).all()


def test_models_equal_naive_ones():
    rng = random.Random(4)
    words = {"x": [f"{a}{b}o" for a in "bcd" for b in "ae"], "y": [f"{a}{b}ks" for a in "wz" for b in "iu"]}
    texts, langs = zip(*[(" ".join(rng.choices(words[x], k=30)), x) for x in "xy" * 30], strict=True)
    model = language.fit(list(texts), list(langs), centroids=3, dimensions=256)
    for text in (*texts[:6], "bao wiks 12", "qqq"):
        grams = collections.Counter(language.gram_ids(text, 256).tolist())
        vector = np.array([math.log1p(grams[i]) * model.idf[i] for i in range(256)])
        cosines = [float(vector @ c) / math.sqrt(float(vector @ vector)) for c in model.centroids]
        names, scores, _ = model.predict([text])
        assert names == [model.languages[model.owner[int(np.argmax(cosines))]]] and scores[0] == pytest.approx(min(1, max(0, *cosines)), abs=1e-4)
    tox = toxicity.fit([f"{t} {'vile' if i % 3 == 0 else ''}" for i, t in enumerate(texts)], [int(i % 3 == 0) for i in range(60)], at_least=1)
    for text in ("bao vile wiks", "bao", "", texts[3]):
        rows = tox.features.rows(toxicity.words_of(text)).tolist()
        e = [np.concatenate([tox.weights["whole"][a], tox.weights["start"][b]]) for a, b in rows] + [np.zeros(2 * toxicity.DIM)] * (toxicity.GAP + 1)
        pooled = []
        for width in toxicity.WIDTHS:
            at = range(len(rows) + 1)  # a filter may reach into the gap after the text
            pooled += [max(sum(float(e[i + d] @ tox.weights[f"conv{width}"][d][:, k]) for d in range(width) if i + d < len(e)) for i in at) for k in range(toxicity.FILTERS)]
        logit = float(np.maximum(np.array(pooled) + tox.weights["bias"], 0) @ tox.weights["out"] + tox.weights["out_bias"][0]) - tox.threshold[""]
        assert tox.score([text])[0] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-4)
    view = quality_classifier.text_view(["Ab, ab", ""])
    assert view.shape[0] == 2 and view[1].sum() == 1 and (view >= 0).all()


def test_pipeline_stages_keep_columns(spark, docs, empty):
    import corpus_pipeline

    for path in (docs, empty):
        df = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.lit(c) for c in ("__row_0", "__Copies_0", "copies", "class_id", "kept", "target")})
        columns = df.columns
        for name, stage in corpus_pipeline.STAGES:
            df = corpus_pipeline.checkpointed(stage(spark, df, path))
            assert name == corpus_pipeline.STAGES[-1][0] or df.columns == columns
    assert df.count() == 0


def _shingled(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def test_pipeline_stages_equal_brute_force(spark, docs):
    """Each stage on the input of the stage before, nulls, repeated ids and repeated rows among them."""
    import corpus_pipeline

    stages, df = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{docs}/documents.parquet")
    key = lambda r: (r.doc_id is None, r.doc_id, r.text)
    bag = lambda rows: collections.Counter(map(key, rows))
    before, after = df.collect(), corpus_pipeline.checkpointed(stages["toxicity"](spark, df, docs))
    model = toxicity.fit_documents(df, spark.read.parquet(f"{docs}/labels.parquet").select("doc_id", "toxic"))
    assert bag(after.collect()) == bag([r for r in before if model.score([r.text])[0] < 0.5])
    kept = collections.Counter()
    for r in quality_rules.measure(after).collect():
        kept[key(r)] += r.kept
    df = corpus_pipeline.checkpointed(stages["quality_rules"](spark, after, docs))
    assert bag(df.collect()) == +kept and kept
    # near copies, on the whole table: the first of each class stays
    whole = spark.read.parquet(f"{docs}/documents.parquet")
    sets = [(key(r), _shingled(r.text)) for r in before]
    union = components.UnionFind()
    for i, (_, a) in enumerate(sets):
        union.find(i)
        for j in range(i):
            if a and sets[j][1] and len(a & sets[j][1]) >= 0.8 * len(a | sets[j][1]):
                union.join(i, j)
    classes = collections.defaultdict(list)
    for i, (k, _) in enumerate(sets):
        classes[union.find(i)].append(k)
    got = bag(stages["ngram_join"](spark, whole, docs).collect())
    assert len(classes) == sum(got.values()) and all(sum(got[k] for k in set(x)) == 1 for x in classes.values())
    assert all(got[min(x, key=lambda k: k[:2] if k[1] is not None else (True, 0))] for x in classes.values() if len({k[:2] for k in x}) == len(x))
    # mixing: each row its own copies
    mixed = stages["mixing"](spark, whole, docs).collect()
    sources = {r.source for r in before}
    n = lambda t: len(WORD.findall(t or ""))
    by = sorted(sources, key=lambda x: (x is None, x or ""))
    sizes = [sum(n(r.text) for r in before if r.source == x) for x in by]
    for x, target in zip(by, mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(by))], sum(sizes)), strict=True):
        assert abs(sum(n(r.text) for r in mixed if r.source == x) - target) <= max(n(r.text) for r in before)
    copies, rows_ = bag(mixed), bag(before)
    assert all(copies[k] <= 3 * rows_[k] for k in copies)


def test_null_and_repeated_ids_in_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string, __copies string")
    got = stages["ngram_join"](spark, frame([(5, x, "s", "a"), (5, y, "s", "b"), (3, x, "s", "c"), (None, y, "s", "d")]), "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(3, x), (5, y)]
    many = [(None, f"{x} {i}", "s", "a") for i in range(100)]
    out = stages["mixing"](spark, frame(many), "").collect()
    assert collections.Counter(map(tuple, out)) == collections.Counter(many) and stages["mixing"](spark, frame(many), "").columns == ["doc_id", "text", "source", "__copies"]
