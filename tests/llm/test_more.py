"""Whole queries against brute force, odd and long texts, recall, the pipeline's stages."""

import collections
import os
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pointweave.llm import bitfilter, blobs, kernel, packing, queries, rarest, secret_ledger, workspace
from pointweave.llm.decontaminate import Decontaminator
from pointweave.llm.langid import LanguageId
from pointweave.llm.minmax_dedup import MinMaxDedup
from pointweave.llm.substring_dedup import SubstringDedup
from pointweave.llm.suffix_tree import SuffixTreeScorer
from pointweave.llm.workspace import Workspace

SF = "/root/testdata/sf0.01"


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(sets, num, den):
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    seen = {(min(i, j), max(i, j)) for ids in where.values() if len(ids) < 400 for i in ids for j in ids if i != j}
    for i, j in seen:
        if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return {i: root(i) for i in sets}


def plain_words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())


def closest(item, doc):
    """Least number of word edits between an item and any part of a document."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for x in doc:
        new = [0]
        for i, y in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != y)))
        row = new
        best = min(best, row[-1])
    return best


@pytest.mark.parametrize("limits", [{}, {"items": 3}, {"chars": 150}])
def test_no_benchmark_item_is_missed(spark, limits):
    rng = np.random.default_rng(4)
    items = [" ".join(f"w{x}" for x in rng.integers(0, 6, rng.integers(1, 40))) for _ in range(12)]
    docs = [" ".join(f"w{x}" for x in rng.integers(0, 6, rng.integers(0, 60))) for _ in range(30)]
    for k in range(30):  # items with more and more edits
        w = items[k % 12].split()
        for _ in range(k // 4):
            at = int(rng.integers(0, len(w)))
            w[at : at + int(rng.integers(0, 2))] = [f"w{rng.integers(0, 6)}"] * int(rng.integers(0, 2))
        docs.append(f"one {' '.join(w)}, two")
    want = {(d, i, closest(plain_words(b), plain_words(a))) for d, a in enumerate(docs) for i, b in enumerate(items)}
    want = {(d, i, k) for d, i, k in want if k <= int(len(plain_words(items[i])) * 0.2)}
    got = Decontaminator(**limits).matches(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want) > 40


def test_recall_of_near_copies(spark):
    """Pairs at a similarity just over the bound, in numbers that would show a miss of one in a hundred."""
    rng = np.random.default_rng(8)
    texts, pairs = [], 0
    while pairs < 400:
        w = [f"p{pairs}x{i}" for i in range(120)]
        v = list(w)
        for k in rng.choice(120, 3, replace=False):
            v[k] = f"q{pairs}x{k}"
        a, b = shingles(" ".join(w), 3), shingles(" ".join(v), 3)
        if 0.85 <= len(a & b) / len(a | b) <= 0.9:
            texts += [" ".join(w), " ".join(v)]
            pairs += 1
    got = MinMaxDedup(shingle_words=3, num=85, den=100).components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got.filter("doc_id % 2 = 1 and component_id = doc_id - 1").count() == pairs


def test_last_pass_over_blocks(spark):
    """A bucket of texts of one template, more than a block, of which some are linked."""
    rng = np.random.default_rng(6)
    texts = []
    for i in range(90):
        w = [f"t{k}" for k in range(100)]
        for k in range(0, 100, 12):
            w[k] = f"u{i // 3}x{k}"
        if i % 3:
            w[int(rng.integers(0, 100))] = f"v{i}"
        texts.append(" ".join(w))
    want = components({i: shingles(t, 3) for i, t in enumerate(texts)}, 85, 100)
    for op in (MinMaxDedup(shingle_words=3, num=85, den=100, rounds=1, block=8), MinMaxDedup(shingle_words=3, num=85, den=100)):
        got = {r.doc_id: r.component_id for r in op.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert got == want and len(set(want.values())) == 30


def test_rarest_members_lose_no_pair(spark):
    """A crowd with most members in common: few candidates, all pairs that are similar enough, in one block or several."""
    rng = np.random.default_rng(8)
    draw = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    common, few = draw(300), draw(24)
    sets = []
    for _ in range(400):  # about 300 that all have, some of a few that many have, and some of their own
        sets.append(np.concatenate((rng.choice(common, int(rng.integers(280, 301)), replace=False), rng.choice(few, int(rng.integers(0, 8)), replace=False), draw(int(rng.integers(0, 70))))))
    sets += [np.concatenate((x[:-15], draw(15))) for x in sets[:100]]
    sets = [np.unique(x) for x in sets]
    want, held = set(), [set(x.tolist()) for x in sets]
    for i, x in enumerate(held):
        for j in range(i):
            both = len(x & held[j])
            if i % 7 != j % 7 and 100 * both >= 85 * (len(x) + len(held[j]) - both):
                want.add((j, i))
    crowd = spark.createDataFrame([(i, i % 7, x.tobytes()) for i, x in enumerate(sets)], "id long, label long, set binary")
    for block in (4096, 16):
        found = [(r.a, r.b) for r in rarest.pairs(crowd, 85, 100, block=block).collect()]
        assert len(found) == len(set(found)) and want <= set(found) and len(want) > 1000
    apart = spark.createDataFrame([(i, i, np.unique(np.concatenate((common, draw(60)))).tobytes()) for i in range(400)], "id long, label long, set binary")
    assert rarest.pairs(apart, 85, 100).count() == 0  # 79800 pairs share 300 of 420


def test_rows_of_a_crowded_bucket_follow_its_size(spark, monkeypatch):
    """The last pass writes and joins no more rows of a bucket of unlinked texts than it has members."""
    rng = np.random.default_rng(9)
    common = " ".join(f"c{k}" for k in range(90))
    texts = [f"{common} " + " ".join(f"o{i}x{k}" for k in range(int(rng.integers(14, 18)))) for i in range(160)]
    texts += [t + " z" for t in texts[:20]]
    want = components({i: shingles(t, 3) for i, t in enumerate(texts)}, 85, 100)
    rows, keep = {}, Workspace.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(Workspace, "keep", counted)
    got = MinMaxDedup(shingle_words=3, num=85, den=100, rounds=1, block=8).components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert rows["rows"] > 8 * 160 and rows["near"] <= rows["rows"] and rows["crowd"] <= len(texts)


def test_texts_of_other_languages_are_rejected(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 200")
    language = LanguageId()
    model = language.fit(table.filter("lang in ('fr', 'de')"), queries.LANGUAGE_TRAINING)
    named = language.predict(table, model).join(table.select("doc_id", "lang"), "doc_id")
    foreign = named.filter("lang in ('en', 'es')").agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    own = named.filter("lang in ('fr', 'de')").agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    assert foreign > 0.9 and own < 0.05
    every = language.fit(table, queries.LANGUAGE_TRAINING)
    junk = spark.createDataFrame([(1, "Жили-были старик со старухой у самого синего моря"), (2, "日本語のテキストはこちらにあります")], "doc_id long, text string")
    assert all(r.rejected for r in language.predict(junk, every).collect())
    # capital letters beyond ASCII make no difference, in fitting or prediction
    low, up = (language.predict(spark.createDataFrame([(1, t)], "doc_id long, text string"), every).first() for t in ("ein über größe äpfel", "EIN ÜBER GRÖßE ÄPFEL"))
    assert (low.lang_pred, low.score) == (up.lang_pred, up.score)


def test_the_driver_holds_the_sample_once(spark, monkeypatch):
    seen, train = [], LanguageId._train

    def held(self, data, languages):
        seen.append((sum(x.nbytes for row in data for x in row if isinstance(x, np.ndarray)), sum(len(row[0]) for row in data), len(data)))
        return train(self, data, languages)

    monkeypatch.setattr(LanguageId, "_train", held)
    model = LanguageId(steps=50).fit(spark.read.parquet(f"{SF}/documents.parquet"), "true")
    size, subwords, rows = seen[0]
    assert rows > 100 and size <= 6 * subwords and model.languages


def test_equal_texts_and_shuffled_documents_score_alike(spark):
    rows = [(i, f"a b c d{i % 3} a b c") for i in range(60)] + [(7, "a b c d1 a b c")] * 5 + [(7, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = SuffixTreeScorer().score(df, "doc_id % 7 <> 2").collect()
    two = SuffixTreeScorer(cached=1, rounds=3).score(df.repartition(5, "text"), "doc_id % 7 <> 2").collect()
    key = lambda rows: sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in rows)
    assert key(one) == key(two) and len(one) == len(rows)


def test_a_round_leaves_only_totals(spark):
    rows = [(i, f"a b c d{i % 3} a b c") for i in range(60)]
    folder = workspace.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    got = SuffixTreeScorer(cached=1).score(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id % 7 <> 2").collect()
    (own,) = set(os.listdir(folder)) - before
    left = [x.split("-", 1)[1] for x in sorted(os.listdir(f"{folder}/{own}"))]
    assert len(got) == 60 and left.count("totals") == 2 and "sums" not in left


def test_release_lets_shuffles_go(spark):
    work, shuffles = Workspace(spark, "release"), spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses
    workspace.release(spark)
    time.sleep(1)
    for i in range(4):
        time.sleep(0.2 * i)  # the thread that lets handles go may be anywhere in its second
        before = shuffles().size()
        work.keep(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("x")).count(), "counts")
        assert shuffles().size() > before
        workspace.release(spark)
        time.sleep(0.5)
        assert shuffles().size() <= before


def test_other_tokenizers_encode_whole_texts(spark):
    path, texts = public_tokenizers.path("byte_bpe_50k.json"), ["Two  Words", "", None, "x\n\ny <|endoftext|> z"]
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    for i, t in enumerate(texts):
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(got, key=lambda r: r.start) if r.doc_id == i])
        assert ids.tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids + [1]


def test_parts_of_words_make_the_same_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["don't I'll '' ''s a's.b 12ab!!x", "<|endoftext|>q<|ENDOFTEXT|>", "\x00 \x7f a\x1cb é ́e", "é ẞ İ Σς 日本語 ٣٤ x y　z ½²", "A" * 3000, "~!@#$%^&*()_+`-=[]\\{}|;:\",./?>"]
    tokenizer, own = Tokenizer.from_file(path), packing.WordTokenizer(path, 5)
    assert own.by_parts
    for _ in range(2):
        for first, ids, bounds in own.encode(pa.array(texts)):
            for i in range(len(bounds) - 1):
                assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(texts[first + i], add_special_tokens=False).ids


def test_hashes_in_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join("x" * int(n) + str(n) for n in rng.integers(0, 90, rng.integers(0, 60))) for _ in range(30)]

    def hashes():
        out = []
        for c in kernel.chunks(pa.array(texts)):
            w = kernel.words(c)
            h = kernel.word_hashes(c, w)
            out.append((h, *kernel.windows(h, w.of, 5), kernel.sequence_hash(h, w.of, 2), kernel.rejoined(c, w, np.ones(len(h), bool)).to_pylist()))
        return out

    whole = hashes()
    monkeypatch.setattr(kernel, "BLOCK", 41)
    for a, b in zip(whole, hashes(), strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
    assert whole[0][4] == [" ".join(t.split()) for t in texts]


def test_blobs_and_filters(spark):
    rng = np.random.default_rng(1)
    keys, n = np.sort(rng.integers(0, 2**64, 5000, dtype=np.uint64)), rng.integers(0, 9, 5000)
    rows = list(blobs.deal(0, ("d8", "u4"), blobs.bucket_of(keys, 7), keys, n))
    back = [x for b in rows for x in blobs.read([b], {0: ("d8", "u4")})]
    assert np.array_equal(np.concatenate([c[0] for _, _, c, _ in back]), keys) and np.array_equal(np.concatenate([c[1] for _, _, c, _ in back]), n)
    df = spark.range(3000).select(F.xxhash64("id").alias("k"))
    there = df.toArrow()["k"].to_numpy().view(np.uint64)
    for bits in (16, 27):
        assert bitfilter.build(spark, df, "k", 3000, bits).value.has(there).all()
    assert not bitfilter.build(spark, df.limit(0), "k", 0).value.has(there).any()
    assert workspace.in_order(spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0")) and not workspace.in_order(df.repartition(2))


def test_filters_of_repeats_take_one_worker_a_task(spark, monkeypatch):
    df = spark.range(3000).select(F.xxhash64("id").alias("k"))
    twice = bitfilter.build(spark, df, "k", 3000, made=lambda b: (pa.RecordBatch.from_arrays([pa.array(np.repeat(x.column(0).to_numpy(), 2))], names=["k"]) for x in b))
    assert np.array_equal(twice.value.words, bitfilter.build(spark, df, "k", 3000).value.words)

    plans, build = [], bitfilter.build

    def recorded(spark, keys, *rest, **named):
        plans.append(keys._jdf.queryExecution().optimizedPlan().toString())
        return build(spark, keys, *rest, **named)

    monkeypatch.setattr(bitfilter, "build", recorded)
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words), (2, f"x {words} y"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in SubstringDedup().cut(docs).collect()}
    assert got == {1: words, 2: "x y", 3: ""}
    assert len(plans) == 3 and not any("MapInArrow" in p for p in plans)  # build() adds a Python step of its own


def test_long_texts(spark, tmp_path):
    """Texts of several chunks, words of more than a block, through every query."""
    long = " ".join(f"w{i % 4099}x{i % 7}" for i in range(400_000))
    rows = [(1, long, "en"), (2, "start " + long, "en"), (3, "y" * 2_500_000 + " end", "fr"), (4, None, None), (5, "short text of words", "fr"), (6, "password=abcdefgh " + long[:50], "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "short text of words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {name: {r.doc_id: r for r in f(spark, str(tmp_path)).collect()} for name, f in queries.QUERIES.items() if name != "op2_packing"}
    assert {r.component_id for i, r in got["op1_minmax_dedup"].items() if i < 3} == {1} and got["op1_minmax_dedup"][3].n_shingles == 1
    assert got["op3_suffix_tree"][2].n_tokens == 400_002 and set(got["op4_decontaminate"]) == {5} and got["op5_secret_ledger"][6].n_assign == 1
    assert got["op6_sketch"][1].near_next > 0.9 and got["op9_substring_dedup"][2].n_removed >= 399_950 and got["op9_substring_dedup"][3].n_words == 2
    assert all(len(v) == 6 for k, v in got.items() if k != "op4_decontaminate")
    pieces = queries.op2_packing(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(pieces) == 6 and all(r.n == r.m for r in pieces)


# --- the pipeline ------------------------------------------------------------------------------------
RULES = [(re.compile(r.pattern.replace("(?i:(password|passwd|secret|token|api_?key))", "((?i:password|passwd|secret|token|api_?key))")), r.group, r.least) for r in secret_ledger.RULES]


def redacted(text):
    spans = sorted((m.start(), n, m.end()) for n, (p, g, least) in enumerate(RULES) for m in p.finditer(text) if len(m.group(g)) >= least)
    out, at = "", 0
    for s, _, e in spans:
        if s >= at:
            out += text[at:s] + "[secret]"
        at = max(at, e)
    return out + text[at:]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents with copies, near copies, benchmark passages, secrets and odd rows, under columns that clash with the operators' own."""
    at = tmp_path_factory.mktemp("planted")
    base = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) between 300 and 4000").orderBy("doc_id").limit(260).collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(6).collect()]
    rng, rows = np.random.default_rng(2), []
    for i, (text, lang) in enumerate(base):
        rows.append((i, text, lang))
    for i in range(0, 60, 3):  # near copies
        w = rows[i][1].split(" ")
        for _ in range(max(1, len(w) // 120)):
            w[int(rng.integers(0, len(w)))] = "changed"
        rows.append((300 + i, " ".join(w), rows[i][2]))
    rows += [(400 + i, base[100 + i][0], base[100 + i][1]) for i in range(10)]
    rows += [(500 + i, base[120 + i][0] + " " + items[i] + " " + base[130 + i][0], base[120 + i][1]) for i in range(6)]
    rows += [(600 + i, f"{base[140 + i][0]} password = {'k' * (5 + i)} and AKIA{'Q7' * 9} {base[150 + i][0]}", base[140 + i][1]) for i in range(4)]
    rows += [(700, None, "en"), (701, "", "en"), (702, "1234 !!", "en"), (0, base[0][0], base[0][1])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, blob string, component_id long, kept boolean, rejected string"
    full = [(i, t, g, "s", None if t is None else len(t), "b", 1, None, "r") for i, t, g in rows] + [(None, base[200][0], "en", None, 5, None, None, None, None)]
    spark.createDataFrame(full, schema).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), items


def rows_of(df):
    return collections.Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_each_stage_against_brute_force(spark, planted):
    at, items = planted
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{at}/documents.parquet")

    def after(name, df):
        out = stages[name](spark, df, at)
        assert out.schema == df.schema
        rows = out.collect()
        return spark.createDataFrame(rows, out.schema), rows_of(out)

    # language: what is kept is as it was; texts without a letter go, and few others
    kept, got = after("language_id", docs)
    before = rows_of(docs)
    assert not got - before and not any(i in (700, 701, 702) for i, _ in got) and sum(got.values()) >= 0.95 * sum(before.values())
    # near copies: of each group the least id, whichever rows it has
    texts = {i: t for i, t in got if i is not None}
    root = components({i: shingles(t, 5) for i, t in texts.items()}, 80, 100)
    assert sum(root[i] != i for i in root) >= 25
    kept, deduped = after("near_dedup", kept)
    assert deduped == collections.Counter({k: n for k, n in got.items() if k[0] is None or root[k[0]] == k[0]})
    # benchmark passages
    words = [plain_words(x) for x in items]
    leaked = {i for i, t in deduped if i is not None and any(closest(w, plain_words(t)) <= int(len(w) * 0.2) for w in words)}
    assert {500 + i for i in range(6)} & {i for i, _ in deduped} <= leaked and len(leaked) >= 3
    kept, clean = after("decontaminate", kept)
    assert clean == collections.Counter({k: n for k, n in deduped.items() if k[0] not in leaked})
    # secrets: every row stays, its text and size made to fit
    kept, safe = after("secrets", kept)
    assert safe == collections.Counter({(i, redacted(t)): n for (i, t), n in clean.items()})
    assert sum(n for (_, t), n in safe.items() if "[secret]" in t) >= 2 and kept.filter("text like '%[secret]%' and n_chars <> length(text)").count() == 0
    # packing: every id of every document once
    tokenizer, pieces = Tokenizer.from_file(queries.TOKENIZER), collections.defaultdict(list)
    for r in stages["packing"](spark, kept, at).collect():
        pieces[r.doc_id].append((r.start, r.ids))
    assert set(pieces) == {i for i, _ in safe if i is not None}
    for (i, t), n in safe.items():
        if i is not None:
            ids = b"".join(x for _, x in sorted(pieces[i]))
            want = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
            assert sorted(ids) == sorted(want * n) and (n > 1 or ids == want)


def test_the_pipeline_runs_its_stages_in_turn(spark, planted):
    at, _ = planted
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
    want = {r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None}
    assert {r.doc_id for r in corpus_pipeline.run(spark, at).select("doc_id").distinct().collect()} == want


def test_stages_on_an_empty_table(spark, planted, tmp_path):
    at, _ = planted
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, at).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{at}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
