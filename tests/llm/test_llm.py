"""Each training-data operator against brute force, with nulls, blanks, long texts, ties, repeats and clashing columns."""

import gzip
import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill import session
from corpusmill.llm import bpe, components, exact_dedup, library_tokens, line_dedup, near_text, packing, perfect_hash, quality, sharding, simhash, token_counts, token_files, warc
from corpusmill.llm.library_tokens import ChunkEncoder
from corpusmill.llm.queries import tokenizer_file
from corpusmill.session import materialize, scratch_path

tokenizers = pytest.importorskip("tokenizers")

ODD = ["", " ", "a  b", "a\n\nb c", " <|endoftext|>x", "foo  <|endoftext|>  bar", "x\x1cy \x1d z", "İstanbul ΣΑΣ Σ é ́a", "don't WE'LL 123 45 x　y", "日本語 テスト 😀👍🏽", "tab\t\tx \r\n y  ", "x" * 300, "the" * 100, "Ǆ ﬁ ½ ² ١٢ क्षि", "a<|startoftext|><|endoftext|>b"]
SCHEMA = "doc_id long, text string, source string, h string, keep_id long, row string, n long, shard string"
GOOD = "It was a plain day and the people went about their work with care, as they did on every other day of that year. Nothing much happened and all were glad of it, more or less."


def docs(spark, texts, ids=None):
    """A table with columns whose names clash with those inside the operators."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None if i is None else f"src{i % 2}", "h", 7, "row", 1, "s") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------ 1
def brute_lines(rows):
    lines = [((i, k), frozenset(x.lower().split())) for i, t in sorted(rows) for k, x in enumerate((t or "").split("\n"))]
    first = {}
    for at, s in lines:
        first.setdefault(s, at)
    near = {s: [first[o] for o in first if o and s and o != s and 9 * len(s & o) >= 4 * (len(s) + len(o))] for s in first}
    return {at: (*first[s], len(near[s]), first[s] != at or any(x < at for x in near[s])) if s else (*at, 0, False) for at, s in lines}


@pytest.mark.parametrize("hot", [line_dedup.HOT, 3])
def test_line_dedup(spark, monkeypatch, hot):
    """With most tokens usual, and with nearly all of them compared in blocks."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "BLOCK", 4 if hot == 3 else line_dedup.BLOCK)
    random.seed(5)
    base = [[f"w{random.randint(0, 400)}" for _ in range(random.randint(1, 30))] for _ in range(12)]
    texts = []
    for _ in range(40):
        rows = []
        for b in random.sample(base, 4):
            b = [w if random.random() > 0.05 else f"n{random.randint(0, 99)}" for w in b]
            rows.append(" ".join(b).upper() if random.random() < 0.2 else "  ".join(b))
        texts.append("\n".join(rows))
    texts += [None, "", "\n \n", "one", "one", " ".join(f"v{i}" for i in range(5000))]
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.removed) for r in line_dedup.line_classes(docs(spark, texts)).collect()}
    want = brute_lines(list(enumerate(texts)))
    assert got == want and any(v[3] for v in want.values())
    out = {r.doc_id: r for r in line_dedup.without_repeats(docs(spark, texts).withColumn("n_chars", F.length("text"))).collect()}
    for i, t in enumerate(texts):
        keep = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not want[i, k][3])
        assert out[i].text == keep and (keep is None or out[i].n_chars == len(keep)) and out[i].row == "row"


def test_line_dedup_long_lines(spark):
    """Sets of 20,000 tokens right at the threshold and one token below it."""
    n = 18_000
    base = [f"t{i}" for i in range(n)]
    at = [base[: n - 2000] + [f"{x}{i}" for i in range(2000)] for x in "pq"]  # 16,000 shared of 20,000: 0.8
    below = [base[: n - 2000 - 1] + [f"{x}{i}" for i in range(2001)] for x in "rs"]
    texts = [" ".join(x) for x in (*at, *below)]
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.removed) for r in line_dedup.line_classes(docs(spark, texts)).collect()}
    want = brute_lines(list(enumerate(texts)))
    assert got == want and {v[2] for v in want.values()} == {0, 1}


def test_line_dedup_near_copies(spark, monkeypatch):
    """A group of near copies: no join gives a row for each of its pairs."""
    monkeypatch.setattr(line_dedup, "HOT", 32)
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    texts = [" ".join([f"w{i}" for i in range(40) if i != k % 40] + [f"own{k}"]) for k in range(200)]
    got = {r.doc_id: (r.class_doc_id, r.n_links, r.removed) for r in line_dedup.line_classes(docs(spark, texts)).collect()}
    assert got == {k: (k, 199, k > 0) for k in range(200)}


def test_line_dedup_sends_sets_once(spark, monkeypatch):
    """Whole sets go to the label of their pairs, not along with each pair, and those of hot lists are not stored again."""
    monkeypatch.setattr(line_dedup, "HOT", 32)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, stored = {}, []

    def spied(df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        stored.extend([name] if "array<bigint>" in dict(df.dtypes).values() else [])
        return materialize(df, name, **options)

    monkeypatch.setattr(line_dedup, "materialize", spied)
    monkeypatch.setattr(session, "materialize", spied)
    texts = [" ".join([f"g{k % 9}w{i}" for i in range(40) if i != k % 40] + [f"own{k}"]) for k in range(90)] + [" ".join([f"h{i}" for i in range(40)] + [f"own{k}"]) for k in range(60)]
    try:
        got = {r.doc_id: r.n_links for r in line_dedup.line_classes(docs(spark, texts)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {k: 9 if k < 90 else 59 for k in range(150)}
    assert "hashpartitioning(label" in plans["line-pairs"] and "hashpartitioning(b#" not in plans["line-pairs"]
    assert set(stored) == {"line-sets"}


def test_near_dedup_sends_sets_once(spark, monkeypatch):
    """Whole sets go to the label of their pairs, not along with each pair."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = {}

    def spied(df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return materialize(df, name, **options)

    monkeypatch.setattr(session, "materialize", spied)
    monkeypatch.setattr(near_text, "materialize", spied)
    texts = [" ".join([f"g{k % 4}w{i}" for i in range(80)] + [f"own{k}"]) for k in range(24)]
    try:
        got = {r.doc_id: r.component_id for r in near_text.near_duplicates(docs(spark, texts)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {k: k % 4 for k in range(24)}
    assert "hashpartitioning(label" in plans["near-links"] and "hashpartitioning(b#" not in plans["near-links"]


def test_line_dedup_edges(spark):
    assert line_dedup.line_classes(empty(spark)).count() == 0 and line_dedup.without_repeats(empty(spark)).count() == 0
    same = line_dedup.without_repeats(docs(spark, ["a b c", "a b c", "a b c"], [4, 4, None]).coalesce(1))
    assert sorted(r.text for r in same.collect()) == ["", "", "a b c"]


def test_line_dedup_disk(spark, monkeypatch):
    """Many more lines to verify than are broadcast at a time: whole sets are stored for these only, and plans stay short."""
    rng = random.Random(3)
    texts = [None, ""]
    for _ in range(15):
        words = [f"w{rng.randrange(3000)}" for _ in range(30)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"]) + "\n" + " ".join(f"x{rng.randrange(10**9)}" for _ in range(40))]
    held = {}

    def spied(df, name, **options):
        out = materialize(df, name, **options)
        held[name] = [*held.get(name, []), (out.count(), "array<bigint>" in dict(df.dtypes).values())]
        return out

    monkeypatch.setattr(line_dedup, "materialize", spied)
    monkeypatch.setattr(line_dedup, "BROADCAST_CLASSES", 10)
    rows = [(None, "a b c d e f g h"), *list(enumerate(texts)), (4, texts[4]), (None, "a b c d e f g h i")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = Counter(tuple(r)[2:] + (r.doc_id,) for r in line_dedup.line_classes(df).select("doc_id", "rid", "line_no", "class_doc_id", "class_line_no", "n_links", "removed").collect())
    order = [i for i, _ in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))]
    want = brute_lines([(k, rows[i][1]) for k, i in enumerate(order)])
    name = lambda k: rows[order[k]][0]
    assert got == Counter((n, name(c), m, links, gone, name(k)) for (k, n), (c, m, links, gone) in want.items())
    assert {n for n, found in held.items() if any(sets for _, sets in found)} == {"line-sets"}
    assert len(held["line-sets"]) > 1 and sum(n for n, _ in held["line-sets"]) < sum(n for n, _ in held["lines"])
    keys = line_dedup._keys(F.array(F.xxhash64("text")), [100] * line_dedup.BUCKETS)
    assert len(df.select(keys)._jdf.queryExecution().toString()) < 8_000_000


def test_line_dedup_one_exchange(spark):
    """Postings are shuffled once for both sides of the join on tokens."""
    rows = [(t, c, 0, 0, (10 << 32) + i) for c in range(40) for i, t in enumerate(range(c % 7, c % 7 + 5))]
    postings = materialize(spark.createDataFrame(rows, "token int, cls long, all long, high long, at long"), "postings")
    found = line_dedup.similar_classes(postings)
    assert found.count() and len(found.collect()) == len({tuple(r) for r in found.collect()})
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("REPARTITION_BY_COL") - plan.count("ReusedExchange") == 1, plan


def test_line_dedup_leaves_no_tables(spark, monkeypatch):
    """The texts are joined after the tables of lines are gone."""
    held = []

    def spied(df, name, **options):
        held.append((name, materialize(df, name, **options)))
        return held[-1][1]

    monkeypatch.setattr(line_dedup, "materialize", spied)
    out = line_dedup.without_repeats(docs(spark, ["a b c\nd e f", "d e f\ng"]))
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = lambda at: path(at).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(at))
    assert [there(at) for name, df in held if name in ("lines", "line-known") for at in df.inputFiles()[:1]] == [False, False]
    assert sorted(r.text for r in out.collect()) == ["a b c\nd e f", "g"]


# ------------------------------------------------------------------ 2
def brute_print(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = [*ODD, None, "ÀB cd EF", "a b", "a b c d"]
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(docs(spark, texts)).collect()}
    assert got == {i: brute_print(t, 3) for i, t in enumerate(texts)}
    df = spark.createDataFrame([("a b c",)], "t string")
    assert df.select(F.xxhash64("t")).first()[0] & (1 << 64) - 1 == simhash.fingerprint("A b  c", 3)


def brute_components(fps, distance):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = defaultdict(set)
    for f in fps:
        groups[find(f)].add(f)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize(("distance", "hot"), [(2, 2000), (3, 2000), (2, 4)])
def test_links(spark, monkeypatch, distance, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    random.seed(distance)
    fps = set()
    for _ in range(25):
        f = random.getrandbits(64)
        for _ in range(8):
            fps.add(f)
            for _ in range(random.randint(0, 3)):
                f ^= 1 << random.randrange(64)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.close_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), distance)
    roots = {r.node: r.root for r in components.components(links).collect()}
    groups = defaultdict(set)
    for f in signed:
        groups[roots.get(f, f)].add(f & (1 << 64) - 1)
    assert sorted(map(sorted, groups.values())) == brute_components(fps, distance)


def test_near_duplicates(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    df = docs(spark, [long, long + " end", None, "", "one two three four", long], [9, 8, 7, 6, 5, 4])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got[9] == got[4] == 4 and got[7] == got[6] == 6 and got[5] == 5
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == {k for k, v in got.items() if k == v}
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


# ------------------------------------------------------------------ 3
def test_sharding(spark, tmp_path):
    names = [f"n{i}" for i in range(7)]
    table = sharding.fill_table(names, 1009)
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if names[a] != "n6") < 1009 * 0.15
    double = Counter(sharding.fill_table(names, 1009, {"n0": 2}))
    assert 1.8 < double[0] / double[1] < 2.2
    for bad in ((names, 1000), (names[:1] * 2, 1009), ([], 7)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def brute_slots(names, size, turns):
    """Each shard's whole order of preference written out, and the first free slot of it taken at every turn."""
    orders = [[(xxhash.xxh64_intdigest(n, seed=1) + j * (xxhash.xxh64_intdigest(n, seed=2) % (size - 1) + 1)) % size for j in range(size)] for n in names]
    owner = {}
    while len(owner) < size:
        for name, order, turn in zip(names, orders, turns, strict=True):
            for slot in [s for s in order if s not in owner][:turn]:
                owner[slot] = name
    return [owner[s] for s in range(size)]


def brute_slot(key, size):
    """Spark's hash of a long: XXH64 of its eight bytes from seed 42; of a null, the seed itself."""
    h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % size


@pytest.mark.parametrize("weights", [None, {"n0": 3, "n4": 2}])
def test_shard_of_each_key(spark, tmp_path, weights):
    """Rows against brute force: nulls, repeats, columns called slot, shard, files and a.b, and a map."""
    names, size = [f"n{i}" for i in range(7)], 1009
    owner = brute_slots(names, size, [(weights or {}).get(n, 1) for n in names])
    rows = [(i, f"t{i}" * 40, 7, "mine", 1, {"k": i}, 2) for i in (*range(300), *[5] * 50, -3, None, 1 << 40)] + [(None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int, shard string, files int, m map<string,bigint>, `a.b` int")
    want = Counter((r[0], r[1], r[3], r[6], brute_slot(r[0], size), owner[brute_slot(r[0], size)]) for r in rows)
    placed = sharding.place(df, ["doc_id"], names, size, weights)
    assert placed.columns == [*df.columns, "_slot", "_shard"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that small files stay apart
    try:
        written = sharding.write_shards(df, ["doc_id"], str(tmp_path / "x"), rows_per_file=20, shards=names, size=size, weights=weights)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for got in (placed, written):
        assert Counter((r["doc_id"], r["text"], r["shard"], r["a.b"], r["_slot"], r["_shard"]) for r in got.collect()) == want
    folders = Counter(f.rsplit("/", 2)[1] for f in written.inputFiles())
    assert len(folders) == 7 and max(folders.values()) > 1
    assert sharding.write_shards(empty(spark), ["doc_id"], str(tmp_path / "y")).count() == 0


def test_sharding_query(spark):
    from corpusmill.llm.queries import op3_sharding

    source = "/root/testdata/sf0.001"
    owner = [sharding.SHARDS[i] for i in sharding.fill_table(sharding.SHARDS)]
    texts = spark.read.parquet(f"{source}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, slot := brute_slot(r.doc_id, sharding.SLOTS), owner[slot], hashlib.sha256((r.text or "").encode()).hexdigest()) for r in texts)
    assert sorted(tuple(r) for r in op3_sharding(spark, source).collect()) == want


# ------------------------------------------------------------------ 4
def test_warc(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * (i + 1)) for i in range(120)] + [(None, None, None), (5, "http://x/5", "again")], "page_id long, url string, html string")
    folder = scratch_path(spark, "w")
    hurt = {3, 77, 118}
    damage = lambda key, raw: raw[:-3] + b"???" if key in hurt else raw
    got = warc.fixity(pages, folder, records=30, damage=damage).collect()
    assert len(got) == 122 and {r.page_id for r in got if r.corrupt} == hurt
    offsets = warc.write_archive(pages, f"{folder}/c", records=30)
    read = warc.extract(offsets, f"{folder}/c").collect()
    assert sorted((r.key is None, r.key or 0, r.body) for r in read) == sorted((r.page_id is None, r.page_id or 0, r.html or "") for r in pages.collect())
    assert warc.fixity(pages.limit(0), f"{folder}/d").count() == 0
    assert warc.audit(warc.read_records(offsets, f"{folder}/c"), warc.read_records(offsets.where("idx <> 1"), f"{folder}/c")).count() == offsets.where("idx = 1").count()
    fields, block = warc.parse(warc.record(1, "u", "b"))
    assert block == b"b" and fields["WARC-Target-URI"] == "u" and gzip.decompress(gzip.compress(block)) == block


# ------------------------------------------------------------------ 5
def test_perfect_hash():
    for n in (0, 1, 2, 63, 5000):
        keys = np.arange(n, dtype=np.uint64) * np.uint64(7919)
        t = perfect_hash.build(keys)
        assert sorted(perfect_hash.lookup(t, keys)) == list(range(n))


def test_token_files(spark):
    path = tokenizer_file("word_bpe_49k.json")
    texts = [*ODD, None, "again", "again", "b"]
    ids = [*range(len(ODD)), 40, 50, 50, None]
    files = token_files.write_token_files(docs(spark, texts, ids), scratch_path(spark, "tf"), path, 1, docs_per_shard=4)
    assert len(files["bounds"]) > 1
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_by_key(docs(spark, texts, ids), files).collect())
    library, want, start = tokenizers.Tokenizer.from_file(path), [], 0
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0)):
        x = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((start, i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert got == want
    alone = token_files.open_token_files(files["folder"])
    assert alone == files and token_files.read_by_key(docs(spark, ["x"], [50]), alone).count() == 2
    assert token_files.read_by_key(docs(spark, ["x"], [999]), files).count() == 0
    none = token_files.write_token_files(empty(spark), scratch_path(spark, "tf"), path, 1)
    assert none["docs"] == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunk_encoder(name):
    path, rng = tokenizer_file(name), random.Random(2)
    alphabet = "abcdeEsST'’ \n\t.,!0é̈ßΣİ日​\xa0<|>#😀\x1c "
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(400)]
    ours, library = ChunkEncoder(path, limit=50), tokenizers.Tokenizer.from_file(path)
    for t, x in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(x, ours.dtype).tolist() == library.encode(t, add_special_tokens=False).ids, t


# ------------------------------------------------------------------ 6
@pytest.mark.parametrize("digest", [F.md5, lambda c: F.md5(F.length(c).cast("string"))])
@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(spark, digest, keep):
    texts = ["a", "b", "a", None, "", "aa", "bb", "a", "a", "x" * 100_000]
    ids = [1, 2, 3, 4, 5, 6, 7, 3, None, 8]
    got = exact_dedup.exact_dedup(docs(spark, texts, ids), keep=keep, digest=digest).collect()
    assert len(got) == len(texts)
    by = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        by[t or ""].append(i)
    for r in got:
        group = next(v for t, v in by.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        least = sorted(group, key=lambda i: (i is not None, i or 0))
        assert (r.group_size, r.keep_id) == (len(group), least[-1 if keep == "max" else 0])
    assert sum(r.kept for r in got) == len(by)
    assert exact_dedup.exact_dedup(empty(spark), digest=digest).count() == 0


# ------------------------------------------------------------------ 7
def test_schedule():
    rng = random.Random(3)
    for _ in range(60):
        totals = [rng.choice([0, 1, 3, 50, rng.randint(0, 300)]) for _ in range(rng.randint(1, 6))]
        weights = None if rng.random() < 0.5 else [Fraction(rng.randint(1, 9)) for _ in totals]
        w = weights or [Fraction(t) for t in totals]
        order = sorted((Fraction(2 * j + 1) / w[i], i) for i, t in enumerate(totals) for j in range(t))
        schedule, taken = packing.Schedule(totals, weights), [0] * len(totals)
        for rank in range(len(order) + 1):
            assert schedule.taken(rank) == taken
            if rank < len(order):
                taken[order[rank][1]] += 1


@pytest.mark.parametrize("weights", [None, {"src0": 1, "src1": 3}])
def test_packing(spark, weights):
    path, texts = tokenizer_file("byte_bpe_50k.json"), [*ODD, None, "lorem ipsum " * 400, "x", "x"]
    ids = [*range(len(texts) - 1), len(texts) - 2]
    library = tokenizers.Tokenizer.from_file(path)
    rows = packing.pack(docs(spark, texts, ids), path, length=64, sequences=4, weights=weights, with_ids=True).collect()
    want = Counter(tuple([*library.encode(t or "", add_special_tokens=False).ids, 0]) for t in texts)
    seqs, whole = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        seqs[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id].append(r)
    last = max(seqs)
    for k, parts in seqs.items():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end == 64 or k == last
    assert sorted(seqs) == list(range(last + 1)) and sum(r.length for r in rows) == sum(len(k) * n for k, n in want.items())
    for i, t in enumerate(texts[:-2]):
        x = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert [y for r in sorted(whole[i], key=lambda r: r.start) for y in r.ids] == x and all(r.doc_tokens == len(x) for r in whole[i])
    assert packing.pack(empty(spark), path).count() == 0
    assert (packing.padded(512), packing.padded(500)) == (512, 1024)


def test_packing_memory(spark, monkeypatch):
    """A worker is never sent more than a bounded number of texts at once, and the session's own setting holds again afterwards."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []

    def spied(df, table, **options):
        seen.append((table, int(spark.conf.get(name))))
        return materialize(df, table, **options)

    monkeypatch.setattr(packing, "materialize", spied)
    before = spark.conf.get(name)
    packing.pack(docs(spark, ["a b", None]), tokenizer_file("byte_bpe_50k.json"))
    assert dict(seen)["packed-ids"] <= 1024 < int(before) == dict(seen)["packed-parts"] and spark.conf.get(name) == before


def test_chunk_cache_bound():
    """What a worker of packing holds of chunks seen: two generations of CACHED and the last text's chunks."""
    coder = library_tokens.encoder(tokenizer_file("byte_bpe_50k.json"), True, 1000)
    for x in range(50):
        list(coder.encode([" ".join(f"{x}a{i}" for i in range(200))]))
    assert coder.limit == 1000 and max(len(coder.cache), len(coder.older), len(coder.parts)) <= 1200
    assert packing.CACHED < library_tokens.CACHE_LIMIT
    library_tokens.give_back()


# ------------------------------------------------------------------ 8
def brute_stats(t):
    words, seen, repeats = (t or "").encode().split(), set(), 0
    for line in (t or "").split("\n"):
        if line.encode().split():
            repeats += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {k for i, w in enumerate(windows) if counts[w] > 1 for k in range(i, i + 8)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t or ""), repeats, len(covered)


def test_stats(spark):
    rng = random.Random(1)
    texts = [*ODD, None, GOOD, GOOD + "\n" + GOOD + "\n \n" + GOOD, "a b c " * 50, *[" ".join(rng.choices("abc", k=60)) for _ in range(20)], " ".join(str(i % 977) for i in range(20_000))]
    rows = quality.judged(docs(spark, texts), quality.DecisionList()).select("row.doc_id", *quality.STATS, "base_failed", "kept").collect()
    for r in rows:
        want = brute_stats(texts[r.doc_id])
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed)


def test_learning(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        texts.append(" ".join(word() + ("***" if bad and rng.random() < 0.6 else "") for _ in range(rng.randint(25, 80))))
        labels.append((i, int(not bad), 0))
    df, lab = docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = quality.learn_from(df, lab.where("doc_id < 300"))
    kept = {r.doc_id for r in quality.keep_good(df, rules).collect()}
    held = range(300, 400)
    assert rules.rules and "symbols" in str(rules)
    assert sum((i in kept) == (i % 4 != 0) for i in held) >= 97
    assert quality.keep_good(df, rules).columns == df.columns
    assert not quality.learn_from(df, lab.limit(0)).rules and not quality.learn_from(empty(spark), lab).rules
    assert quality.judged(empty(spark), rules).count() == 0


# ------------------------------------------------------------------ 9
def test_bpe(spark):
    path, rng = tokenizer_file("word_bpe_49k.json"), random.Random(9)
    alphabet = "abcdeEsST'’ \n\t.,!0é̈ßΣİ日​\xa0<|>#😀\x1c "
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(300)] + ["".join(rng.choices("aeth", k=500))]
    library, ours = tokenizers.Tokenizer.from_file(path), bpe.Bpe(path, limit=100)
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == ids and ours.decode(ids) == library.decode(ids, skip_special_tokens=False)
    df = docs(spark, [*texts[:40], None])
    for r in bpe.encode_digests(df, path).collect():
        ids = library.encode(([*texts[:40], None][r.doc_id]) or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.decode_ids(bpe.encode_ids(df, path), path).count() == 41 and bpe.encode_digests(empty(spark), path).count() == 0


# ------------------------------------------------------------------ 10
def test_token_counts(spark):
    path, rng = tokenizer_file("piece_bpe_32k.model"), random.Random(4)
    pieces = token_counts.read_pieces(path)
    score = token_counts.scores(pieces)
    longest = max(map(len, score))

    def brute(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            n = len(word[i - 1].encode())
            options = [(best[i - 1][0] + n * token_counts.BYTE, best[i - 1][1] - n)]
            options += [(best[j][0] + score[word[j:i]], best[j][1] - 1) for j in range(max(0, i - longest), i) if word[j:i] in score]
            best.append(max(options))
        return -best[-1][1]

    texts = [*ODD, None, *["".join(rng.choices("thereinga é日😀", k=40)) for _ in range(60)]]
    trie = token_counts.Trie(pieces, nodes=40)
    want = {i: (len((t or "").encode().split()), sum(brute("▁" + w.decode()) for w in (t or "").encode().split())) for i, t in enumerate(texts)}
    assert all(trie.count("▁" + w.decode()) == brute("▁" + w.decode()) for t in texts for w in (t or "").encode().split())
    assert {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.token_counts(docs(spark, texts), path).collect()} == want
    assert token_counts.token_counts(empty(spark), path).count() == 0


def test_bpe_every_character():
    """Every code point of the first two planes between other characters: letters, numbers and cases as the library has them."""
    path = tokenizer_file("word_bpe_49k.json")
    own, library = bpe.Bpe(path), tokenizers.Tokenizer.from_file(path)
    for lo in range(1, 0x20000, 8192):
        texts = [f"b{chr(c)}1 .{chr(c)}a" for c in range(lo, min(lo + 8192, 0x20000)) if not 0xD800 <= c < 0xE000]
        for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert own.encode(t) == e.ids, ascii(t)


def test_byte_words():
    """Texts with all kinds of white space, cut with and without the pattern, id for id; words merged by rank where that is proven."""
    coder = ChunkEncoder(tokenizer_file("byte_bpe_50k.json"))
    assert coder.ranked
    random.seed(3)
    parts = [" ", "\n", "a", "é", "B", "1", "'s", "\t", "\xa0", "\x1c", "。", "word", ".", " \n", "\r\n", "\x00", " a", "\nb"]
    for _ in range(5000):
        t = "".join(random.choices(parts, k=random.randint(0, 9)))
        assert next(iter(coder.encode([t]))) == coder._library([t])[0], repr(t)


def test_keep_one_by_row(spark):
    """Rows without an id, and rows that share one, stand for themselves."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    table = docs(spark, [a, a, b, a, c, d], [1, None, None, 2, 2, 3]).withColumn("a.b", F.lit(1)).coalesce(1)
    want = [(None, b), (1, a), (2, c), (3, d)]
    for keep in (simhash.keep_one, near_text.keep_one, lambda x: exact_dedup.keep_one(x, keep="min")):
        out = keep(table)
        assert out.columns == table.columns
        got = sorted([(r.doc_id, r.text) for r in out.collect()], key=lambda r: (r[0] is not None, r))
        assert got == want or keep not in (simhash.keep_one, near_text.keep_one) and {t for _, t in got} == {a, b, c, d} and len(got) == 4


# ------------------------------------------------------------------ pipeline
def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    rows = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "packing"]
    now = rows
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert out.columns == rows.columns and 0 < out.count() <= now.count()
        now = out
    assert now.select("doc_id").distinct().count() > 0
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    first = spark.read.parquet(str(tmp_path / "0"))
    lost = labels.where("quality = 1").join(rows, "doc_id", "left_semi").join(first, "doc_id", "left_anti").count()
    assert lost <= 0.1 * labels.where("quality = 1").count()


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def brute_near(rows):
    """doc_id to the least id of its group, by all pairs."""
    sets, root = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return root


def near_copies(rng):
    """Texts with copies on both sides of 0.8, chains of them, other line breaks and a large group."""
    word = lambda: f"w{rng.randrange(4000)}"
    texts = ["", None, " ", "one two", "One  two", "one two three", "a b c d e", "a b c d e f"]
    for k in range(30):
        words = [word() for _ in range(rng.randrange(30, 200))]
        texts.append(" ".join(words))
        for _ in range(3):
            for _ in range(rng.randrange(k % 6 + 1)):
                words[rng.randrange(len(words))] = word()
            texts.append("".join(w + rng.choice(["\n", " ", "  "]) for w in words))
    tail = [f"t{i}" for i in range(100)]
    for m in range(16, 36):  # overlaps step over the threshold
        texts += [" ".join([*tail[:m], f"x{m}"]), " ".join([f"h{m}", *tail])]
    base = [word() for _ in range(80)]
    for _ in range(60):
        copy = list(base)
        copy[rng.randrange(80)] = word()
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_near_text(spark):
    texts = near_copies(random.Random(5))
    df = docs(spark, texts)
    want = brute_near(list(enumerate(texts)))
    assert {r.doc_id: r.component_id for r in near_text.near_duplicates(df).collect()} == want
    assert 0 < sum(k != v for k, v in want.items()) < len(want)
    assert {r.doc_id for r in near_text.keep_one(df).collect()} == {k for k, v in want.items() if k == v}
    assert near_text.keep_one(df).columns == df.columns and near_text.keep_one(empty(spark)).count() == 0


def test_pipeline_near_dedup(spark, sf):
    import corpus_pipeline

    texts = near_copies(random.Random(6))
    want = brute_near(list(enumerate(texts)))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark, texts), sf).collect()} == {k for k, v in want.items() if k == v}


def test_pipeline_near_dedup_fingerprints(spark, sf, monkeypatch):
    """The stage's groups come from SimHash; what these join wrongly stays apart, and what they miss is joined."""
    import corpus_pipeline

    texts = near_copies(random.Random(7)) + ["p q r s", "P q  r s", "many words " * 40, "many words " * 50 + "and one"]
    found, verified, links = [], [], near_text.similar_links

    def fingerprints(rows, **how):
        found.append((how, near_duplicates(rows, **how)))
        return found[-1][1]

    def spied(docs, classes, shingle, ranks, similarity, likely):
        verified.append(likely.count())
        return links(docs, classes, shingle, ranks, similarity, likely)

    near_duplicates = simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", fingerprints)
    monkeypatch.setattr(near_text, "similar_links", spied)
    want = {k for k, v in brute_near(list(enumerate(texts))).items() if k == v}
    df = docs(spark, texts)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, sf).collect()} == want
    assert [how for how, _ in found] == [{"shingle": 3, "distance": 2}] and verified[0] > 0
    all_one = lambda rows: rows.select("doc_id", F.lit(0).cast("long").alias("component_id"))
    assert {r.doc_id for r in near_text.keep_one(df, grouped=all_one).collect()} == want


def plain_features(text):
    text = text or ""
    words, lines = text.encode().split(), [x for x in text.split("\n") if x.encode().split()]
    n, chars, symbols, again, repeats = brute_stats(text)
    return {
        "words": n,
        "mean_word_chars": chars / max(n, 1),
        "symbols_per_word": symbols / max(n, 1),
        "upper_per_char": sum("A" <= c <= "Z" for c in text) / max(chars, 1),
        "bangs_per_word": text.count("!") / max(n, 1),
        "dup_line_share": again / max(len(lines), 1),
        "repeat_share": repeats / max(len(words), 1),
    }


def plain_quality(rows, rules):
    def good(text):
        f = plain_features(text)
        met = lambda c: f[c.feature] > c.threshold if c.above else f[c.feature] <= c.threshold
        return f["words"] >= 20 and f["repeat_share"] <= 0.3 and not any(all(map(met, r)) for r in rules.rules)

    return [(i, t) for i, t in rows if good(t)]


def plain_lines(rows):
    gone = {at for at, x in brute_lines(rows).items() if x[3]}
    return [(i, t and "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows]


def plain_near(rows):
    root = brute_near(rows)
    return [(i, t) for i, t in rows if root[i] == i]


def assert_packed(pieces, rows):
    """Every document's tokens lie in the sequences once and in order; all sequences but the last are full."""
    library, whole, ends = tokenizers.Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), defaultdict(list), defaultdict(int)
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        whole[r.doc_id].append(r)
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert sorted(ends) == list(range(len(ends))) and all(n == 1024 or k == len(ends) - 1 for k, n in ends.items())
    assert set(whole) == {i for i, _ in rows}
    for i, t in rows:
        ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(whole[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_pipeline_plain(spark, tmp_path):
    """Every stage and the whole run against plain Python, with near copies on both sides of 0.8 at other line breaks."""
    import corpus_pipeline

    rng = random.Random(11)
    fresh = lambda n, mark=0.0: [f"w{rng.randrange(9000)}" + "***" * (rng.random() < mark) for _ in range(n)]
    wrap = lambda words, width: "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))
    texts, labels, close = [None, "", "too short"], [], {}
    for i in range(120):
        labels.append((len(texts), int(i % 3 > 0), 0))
        texts.append(wrap(fresh(rng.randrange(25, 60), 0.0 if i % 3 else 0.6), 15))
    for changed in (0, 1, 2, 3, 4):  # of 100 words: Jaccard 1, 0.90, 0.81, 0.73, 0.66
        for _ in range(3):
            words = fresh(100)
            close[len(texts) + 1] = changed
            texts.append(wrap(words, 10))
            for k in range(changed):
                words[10 + 20 * k] = f"new{len(texts)}x{k}"
            texts.append(wrap(words, 14))
    texts += [texts[-1], texts[-2] + "\nand a line of its own"]
    sf = str(tmp_path / "sf")
    docs(spark, texts).withColumn("n_chars", F.length("text")).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now, rows = spark.read.parquet(f"{sf}/documents.parquet"), list(enumerate(texts))
    rules = quality.learn_from(now, spark.read.parquet(f"{sf}/labels.parquet"))
    assert rules.rules
    for k, ((_, stage), plain) in enumerate(zip(corpus_pipeline.STAGES, [lambda x: plain_quality(x, rules), plain_lines, plain_near], strict=False)):
        stage(spark, now, sf).write.parquet(str(tmp_path / str(k)))
        now, before, rows = spark.read.parquet(str(tmp_path / str(k))), rows, plain(rows)
        assert sorted((r.doc_id, r.text) for r in now.collect()) == rows and rows != before
    left = {i for i, _ in rows}
    assert {i: i in left for i in close} == {i: changed > 2 for i, changed in close.items()}
    assert_packed(corpus_pipeline.pack(spark, now, sf).collect(), rows)
    assert_packed(corpus_pipeline.run(spark, sf).collect(), rows)
