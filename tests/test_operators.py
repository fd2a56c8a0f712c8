import itertools
import random
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import phonetics
from corpusmill.functions import text as X
from corpusmill.operators import annotate, leakage, manifest, maps, perturb, select, validate
from corpusmill.sources import tables


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def one(spark, column, **fields):
    return spark.createDataFrame([tuple(fields.values())], list(fields)).select(column).first()[0]


# ------------------------------------------------------------------ text
@pytest.mark.parametrize(("text", "want"), [("Ａ b！", "ab"), ("x​y﻿", "xy"), ("你 好。😀", "你好😀"), ("", ""), (None, None), ("ﬁn", "fin")])
def test_norm(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.norm(F.col("t"))).first()[0] == want


def test_norm_simplifies(spark):
    df = spark.createDataFrame([("學校a",)], "t string")
    assert df.select(X.norm(F.col("t"), {"學": "学", "學校": "学园"})).first()[0] == "学园a"


def test_spans_and_lists(spark):
    df = spark.createDataFrame([("a😀母b", 1, 3, " x | |y ")], "t string, s int, e int, l string")
    r = df.select(X.cut(F.col("t"), F.col("s"), F.col("e")).alias("c"), X.splice(F.col("t"), F.col("s"), F.col("e"), F.lit("-")).alias("p"), X.split_list(F.col("l")).alias("l"), X.find(F.col("t"), F.lit("母")).alias("f"), X.grams(F.lit("你好吗x好"), (2,)).alias("g"), X.cut(F.col("t"), F.lit(3), F.lit(9)).alias("out")).first()
    assert (r.c, r.p, r.l, r.f, r.g, r.out) == ("😀母", "a-b", ["x", "y"], 2, ["你好", "好吗"], None)


def test_overlap(spark):
    df = spark.createDataFrame([(0, 4, 2, 6), (0, 4, 0, 4), (0, 0, 0, 4), (0, 2, 5, 6), (None, 2, 1, 2)], "a int, b int, c int, d int")
    assert [round(r[0], 4) for r in df.select(X.overlap_ratio(*map(F.col, "abcd"))).collect()] == [0.3333, 1.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize(("mode", "want"), [("compat", "far"), ("documented", "near")])
def test_sounds(spark, mode, want):
    df = spark.createDataFrame([("zi4", "zhi4", "lan2", "lang2")], "a string, b string, c string, d string")
    r = df.select(phonetics.alike(F.lit("x"), F.col("a"), F.lit("y"), F.col("b"), mode).alias("k"), phonetics.alike(F.lit("x"), F.col("c"), F.lit("y"), F.col("d"), mode).alias("n")).first()
    assert (r.k, r.n) == (want, "near")


def test_words_alike(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    df = spark.range(1)
    r = df.select(
        phonetics.words_alike(arr("女", "拳"), arr("nü3", "quan2"), arr("女", "权"), arr("nü3", "quan2")).alias("a"),
        phonetics.words_alike(arr("女", "拳"), arr("nü3", "quan2"), arr("女", "全"), arr("nü3", "quan4")).alias("b"),
        phonetics.words_alike(arr("女"), arr("nü3"), arr("女", "全"), arr("nü3", "quan4")).alias("c"),
    ).first()
    assert tuple(r) == ("perfect", "near", "far")


# ------------------------------------------------------------------ sources and sinks
def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('﻿source_id,text\r\ns1,"a ""b""\nc"\r\n,\r\n'.encode())
    df = tables.read_csv(spark, str(p))
    assert df.columns == ["source_id", "text"]
    assert tables.non_blank_rows(df).collect()[0].text == 'a "b"\nc'
    assert tables.non_blank_rows(df).count() == 1
    tables.write_csv(df, str(tmp_path / "out"), ["text", "source_id", "more"], one_file=True, bom=True)
    again = tables.read_csv(spark, str(tmp_path / "out"))
    assert again.columns == ["text", "source_id", "more"] and values(again.where("source_id = 's1'"), "text") == [('a "b"\nc',)]
    assert tables.read_csv_or_empty(spark, str(tmp_path / "none.csv"), ["x"]).count() == 0
    with pytest.raises(ValueError):
        tables.require(df, ["nothing"])
    with pytest.raises(ValueError):
        tables.read_any(spark, "x.txt")


def test_jsonl_hashes_files(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"text": "Ab", "source": "s"}\n\n{"text": "a b", "source": "t"}\n')
    df = tables.read_any(spark, str(p)).withColumn("norm_sha256", X.sha(X.norm(F.col("text")))).withColumn("orig_file", F.lit("a"))
    out = leakage.hash_list(df, "norm_sha256", "_row", ["source_dataset", "orig_file", "orig_line"])
    assert out.count() == 1 and out.first().source_dataset == "s" and out.first().n_rows == 2
    tables.write_hashes(out, str(tmp_path / "h"))
    assert spark.read.text(str(tmp_path / "h")).count() == 2
    f = tables.files(spark, str(tmp_path), "*.jsonl").first()
    assert f["bytes"] == p.stat().st_size and f["lines"] == 3
    assert manifest.code_manifest(spark, str(tmp_path), {"a.jsonl": "input"}, "*.jsonl").first().role == "input"


def test_maps(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "4|@"), (2, "b", ""), (3, "a", " |5"), (4, "", "x")], "_row long, char string, replacements string")
    assert values(tables.map_many(df, trim=True), "char", "replacements") == [("a", ["4", "@", "5"]), ("b", [])]
    assert values(tables.map_one(df), "char", "replacement") == [("a", " ")]
    tables.write_map(tables.map_many(df, trim=True), str(tmp_path / "m"))
    assert tables.read_csv(spark, str(tmp_path / "m")).first().replacements == "4|@|5"
    tables.append(df, str(tmp_path / "p"))
    tables.append(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 8
    assert "| a |" in tables.to_markdown(df.where("_row = 1").select("char")) and '"char": "a"' in tables.to_json(df.where("_row = 1"))


# ------------------------------------------------------------------ selection
def test_quotas(spark):
    def shares(sizes, target, strict=False):
        table = spark.createDataFrame(list(sizes.items()), "stratum string, n_rows long")
        return {r.stratum: r.quota for r in select.quotas(table, target, strict).collect()}

    assert shares({"a": 10, "b": 10, "c": 1}, 20) == {"a": 9, "b": 9, "c": 2}
    assert shares({"a": 100, "b": 1, "c": 1}, 3) == {"a": 2, "b": 1, "c": 1}
    assert shares({"a": 60, "b": 60, "c": 1, "d": 1, "e": 1}, 6) == {"a": 2, "b": 2, "c": 1, "d": 1, "e": 1}
    assert shares({"a": 10, "b": 10, "c": 1}, 20, strict=True) == {"a": 10, "b": 9, "c": 1}
    assert shares({}, 5) == {} and shares({"a": 3}, 0) == {"a": 0} and shares({"a": 3, "b": 0}, 9) == {"a": 3}


def test_ids(spark):
    h1, h2, h3 = "a" * 10 + "b" * 54, "a" * 10 + "c" * 54, "d" * 64
    df = spark.createDataFrame([(1, h1), (2, h2), (3, h1), (4, h3)], "i long, h string")
    got = dict(values(select.source_ids(df, F.lit("toy"), "h", "i"), "i", "source_id"))
    assert got == {1: "toy-aaaaaaaaaa", 2: "toy-aaaaaaaaaacc", 3: "toy-aaaaaaaaaa-2", 4: "toy-dddddddddd"}
    old = dict(values(select.legacy_ids(df, F.lit("toy"), "h", "i"), "i", "source_id"))
    assert old == {1: "toy-aaaaaaaaaa-1", 2: "toy-aaaaaaaaaa-2", 3: "toy-aaaaaaaaaa-3", 4: "toy-dddddddddd"}


def test_greedy_cover(spark):
    rows = [(f"h{i}", f"e{i % 4}", i % 3, ["A", "B"] if i % 2 else ["A"]) for i in range(30)]
    df = spark.createDataFrame(rows, "hash string, entity string, score int, types array<string>")
    picked = select.greedy_cover(df, 8)
    assert len(picked) == 8 and len({r["hash"] for r in picked}) == 8
    assert max(sum(r["entity"] == e for r in picked) for e in ("e0", "e1", "e2", "e3")) <= 3


def plain_greedy(rows, want, per_entity=3, per_type=100):
    picked, hashes, kinds, entities = [], set(), {}, {}
    while len(picked) < want:
        open_ = [r for r in rows if r[0] not in hashes and entities.get(r[1], 0) < per_entity]
        if not open_:
            break
        best = max(open_, key=lambda r: (max(per_type - kinds.get(t, 0) for t in r[3]), r[2], r[0]))
        picked.append(best[0])
        hashes.add(best[0])
        entities[best[1]] = entities.get(best[1], 0) + 1
        for t in best[3]:
            kinds[t] = kinds.get(t, 0) + 1
    return picked


@pytest.mark.parametrize("case", ["copies", "one hash", "one entity"])
def test_greedy_cover_refills(spark, case):
    """Hundreds of rows of which few can be picked rank above all others of their kind."""
    group = {
        "copies": [("z", "top", 9, ["A"])] * 500,
        "one hash": [("z", f"t{i}", 9, ["A"]) for i in range(500)],
        "one entity": [(f"z{i:03}", "top", 9, ["A"]) for i in range(500)] * 2,
    }[case]
    rows = [*group, *[(f"h{i:03}", f"e{i % 20}", i % 5, ["A"]) for i in range(40)], *[(f"g{i:03}", f"f{i % 20}", i % 5, ["A", "B"]) for i in range(12)]]
    df = spark.createDataFrame(rows, "hash string, entity string, score int, types array<string>")
    assert [r["hash"] for r in select.greedy_cover(df, 40)] == plain_greedy(rows, 40)


# ------------------------------------------------------------------ validation
SEED = ("s1", "你好坏蛋", "2", "4", "坏蛋", "1", "toy", "train", 1)
SEEDS = "source_id string, text string, target_span_start string, target_span_end string, target_span_text string, toxicity_label string, source_dataset string, split string, row_no long"
VARIANT = {"source_id": "s1", "variant_id": "r-s1-Homo-01", "text": "你好怀旦", "attack_family": "phonetic", "attack_type": "Homo", "is_adversarial": "1", "generation_method": "rule", "quality_pass": "pending", "split": "train", "substitution_unit": "char", "homophone_type": "near", "is_pilot": "0", "mapping_source": "formal", "mapping_version": "rm-1", "generation_batch_id": "gb-1"}


def variant_table(spark, drop=(), **changed):
    row = {k: v for k, v in (VARIANT | changed).items() if k not in drop}
    return spark.createDataFrame([(*row.values(), 1)], [*row, "row_no"])


@pytest.mark.parametrize(
    ("changed", "drop", "mode", "listed", "code"),
    [
        ({}, (), "formal", [("other",)], 0),
        ({}, (), "formal", [], 1),
        ({}, (), "pilot", [], 0),
        ({}, (), "formal", None, 2),
        ({}, (), "formal", [("你好 坏蛋",)], 1),
        ({"mapping_source": "placeholder"}, (), "formal", [("other",)], 1),
        ({"mapping_source": "placeholder", "is_pilot": "1"}, (), "pilot", [("other",)], 0),
        ({"is_pilot": "1"}, (), "formal", [("other",)], 1),
        ({}, ("is_pilot",), "formal", [("other",)], 1),
        ({}, ("is_pilot",), "pilot", [("other",)], 0),
        ({"mapping_version": ""}, (), "formal", [("other",)], 1),
        ({"split": "dev", "source_id": "s9"}, (), "pilot", [("other",)], 1),
    ],
)
def test_gate(spark, changed, drop, mode, listed, code):
    seeds = spark.createDataFrame([SEED], SEEDS)
    exclusion = None if listed is None else spark.createDataFrame(listed, "text string")
    assert validate.formal_gate(seeds, variant_table(spark, drop, **changed), exclusion, mode)[0] == code


def test_exclusion_rules(spark):
    seeds = spark.createDataFrame([SEED], SEEDS)
    listed = spark.createDataFrame([("你好坏蛋",)], "text string")
    got = validate.exclusion_violations({"seeds": (seeds, "source_id"), "safe": (None, "item_id")}, listed, version="v1", expected="V2")
    assert sorted(r.rule_id for r in got.collect()) == ["V29", "V31", "V33"]
    assert [r.rule_id for r in validate.exclusion_violations({"seeds": (seeds, "source_id")}, None).collect()] == ["V28"]


# ------------------------------------------------------------------ perturbation
def span_seeds(spark, *spans):
    rows = [(f"s{i}", f"x{t}y", 1, 1 + len(t), "1", "train", i) for i, t in enumerate(spans)]
    return spark.createDataFrame(rows, "source_id string, text string, target_span_start int, target_span_end int, toxicity_label string, split string, _row long")


def test_rules_on_cjk(spark):
    lit = tables.literal_map
    m = {"homo": lit({"坏": ["怀", "淮"], "蛋": ["旦", "但"]}), "pinyin": lit({"坏": ["huai"], "蛋": ["dan"]}), "split": lit({"明": ["日月"], "强": ["弓虽"]}), "homo_word": lit({"笨蛋": ["本单"]}), "leet": lit({"坏": ["6"]})}
    rows = perturb.candidates(span_seeds(spark, "坏蛋", "明强", "笨蛋"), m, random_pick=False)
    by = {}
    for r in rows.collect():
        by.setdefault((r.source_id, r.attack_type), []).append((r.cand_no, r.cand))
    got = {k: [c for _, c in sorted(v)] for k, v in by.items()}
    assert got["s0", "Homo"] == ["怀旦", "淮但"] and got["s0", "PY_Full"] == ["huaidan", "huai dan"] and got["s0", "PY_Abbr"] == ["hd"]
    assert got["s1", "Graph_Split"] == ["日月弓虽"] and ("s1", "Homo") not in got and got["s2", "Homo"] == ["本单"] and got["s0", "Sym_Leet"] == ["6蛋"]
    assert got["s1", "Sym_Separator"] == ["明*强", "明.强", "明 强", "明—强", "明​强"]


def test_swaps(spark):
    got = values(perturb.swaps(span_seeds(spark, "女权", "大坏蛋", "ab", "哈哈")), "variant_id", "swapped_to")
    assert got == [("r-s0-Swap-01", "权女"), ("r-s1-Swap-01", "坏大蛋"), ("r-s1-Swap-02", "蛋坏大")]


def test_cap_and_dedup_in_order(spark):
    random.seed(4)
    for _ in range(2):
        rows = [(f"s{i}", i, k, f"R{k}", c, random.choice("abcdefg")) for i in range(6) for k in range(2) for c in range(4)]
        df = spark.createDataFrame(rows, "source_id string, _row long, rule_no int, attack_type string, cand_no int, new_text string")
        caps = {"R0": 1, "R1": 2}
        want = perturb._in_order((dict(zip(df.columns, r, strict=True)) for r in rows), caps)
        assert values(perturb.dedup_and_cap(df, caps), "_row", "rule_no", "cand_no") == sorted(want)


def test_stamp_and_versions(spark):
    sources = perturb.mapping_sources(["homo"], ["leet"])
    assert (sources["Homo"], sources["Sym_Leet"], sources["PY_Full"]) == ("formal", "placeholder", "none")
    s = span_seeds(spark, "坏蛋")
    made = perturb.generate(s, {"homo": tables.literal_map({"坏": ["怀"], "蛋": ["旦"]})}, ["Homo", "Sym_Separator"])
    out = perturb.stamp(made, sources, "rm-1", perturb.config_version("gb", {"a": 1}), True)
    assert values(out, "attack_type", "mapping_source", "is_pilot") == [("Homo", "formal", "1"), ("Sym_Separator", "none", "1")]
    assert perturb.content_version("rm", [("a", "1"), ("b", "2")]) == perturb.content_version("rm", [("b", "2"), ("a", "1")])


# ------------------------------------------------------------------ annotation and manifests
def rated(spark, pairs):
    mk = lambda k: spark.createDataFrame([(f"s{i}", "text", p[k], None, None, i) for i, p in enumerate(pairs)], "source_id string, text string, toxicity_label string, target_span_start string, target_span_end string, row_no long")
    return annotate.paired(mk(0), mk(1))


def test_kappa(spark):
    r = annotate.kappa(rated(spark, [("1", "1")] * 20 + [("0", "0")] * 25 + [("0", "1")] * 5)).first()
    assert (r.n, round(r.po, 6), round(r.kappa, 6)) == (50, 0.9, 0.8)
    assert annotate.kappa(rated(spark, [("1", "1")] * 3)).first().kappa == 1.0
    assert annotate.kappa(rated(spark, [("?", "1")])).first().kappa is None


def test_summary_and_crosstab(spark):
    df = spark.createDataFrame([("train", "yes", "pass", "Homo"), ("odd", "x", "", "Homo"), ("test", "0", "fail", "Swap")], "split string, toxicity_label string, quality_pass string, attack_type string")
    s = manifest.summary(df).first()
    assert (s.split_train, s.split_other, s.label_1, s.label_missing, s.qc_pending) == (1, 1, 1, 1, 1)
    assert manifest.summary(df.drop("split")).first().split_train is None
    assert values(manifest.crosstab(df, "attack_type", "quality_pass", ["pass", "fail"]), "attack_type", "pass", "fail") == [("Homo", 1, 0), ("Swap", 0, 1)]
    assert manifest.pairs_text(df, "attack_type").first()[0] == "Homo=2;Swap=1"
    assert {r.rule_id for r in manifest.problems(df.drop("quality_pass"), "variants", is_csv=False).collect()} == {"M01", "M03", "M07"}
    assert {r.rule_id for r in manifest.problems(df, "seeds").collect()} == {"M05", "M06"}


def test_containing_short_parts(spark):
    texts = ["one two three four five six seven eight", "xone two three", "", None, "six  seven", "a one two three four five six b", "é"]
    parts = ["two", "one two three", "ne two", "two three four five six", "one two three four five six", "two three four five six seven", "one two three four five six seven", "six seven", "six  seven", "", None, "é", "nine"]
    df, listed = (spark.createDataFrame(list(enumerate(x)), f"{k} long, text string") for x, k in ((texts, "doc_id"), (parts, "item_id")))
    want = {(i, k) for i, t in enumerate(texts) for k, p in enumerate(parts) if t is not None and p is not None and p in t}
    got = [tuple(r) for r in leakage.containing(df, listed, "doc_id", "item_id").collect()]
    assert len(got) == len(want) and set(got) == want


def test_pilot(spark, tmp_path):
    path = str(tmp_path / "log")
    assert manifest.pilot_init(spark, path) and not manifest.pilot_init(spark, path)
    e = spark.createDataFrame([("d", "s1", "Homo", "t", "3", "2", 1), ("d", "s9", "X", "", "999", "9", 2)], "date string, seed_id string, attack_type string, text string, minutes_spent string, difficulty_1to5 string, row_no long")
    seeds = spark.createDataFrame([("s1",)], "source_id string")
    assert sorted(r.rule_id for r in manifest.pilot_checks(e, seeds).collect()) == ["P01", "P02", "P03", "P04", "P05"]
    manifest.pilot_add(e.where("seed_id = 's1'"), path)
    assert "Homo" in manifest.pilot_report(spark.read.parquet(path))


def test_pilot_report_lists_all_blockers(spark):
    rows = [("d", f"s{i:03}", "Homo", "3", "2", f"why {i}!" if i % 3 else " ") for i in range(180)]
    log = spark.createDataFrame(rows, "date string, seed_id string, attack_type string, minutes_spent string, difficulty_1to5 string, blocker string")
    report = manifest.pilot_report(log)
    assert "# Blockers (120)" in report and all((f"| why {i}! |" in report) == (i % 3 > 0) for i in range(180))


def test_split_reasons(spark):
    df = spark.createDataFrame([("明", "日月"), ("a", "bc"), ("强", ""), ("林", "木木木木"), ("好", "女x"), ("回", "回口"), ("冷", "冫令"), ("张", "弓丨")], "char string, replacements string")
    ranks = spark.createDataFrame([("明", 99, 1), ("日", 50, 2), ("月", 40, 3), ("张", 30, 4), ("弓", 5, 3124), ("丨", 1, 3251)], "char string, count long, rank int")
    got = dict(values(maps.split_reasons(df, ranks), "char", "reason"))
    assert got == {"明": None, "a": "char_not_basic", "强": "no_parts", "林": "not_2_or_3_parts", "好": "part_not_basic", "回": "part_is_char", "冷": "char_rare", "张": "part_rare"}
    assert maps.examples(maps.split_reasons(df, ranks), "char").count() == 7


def test_annotation_states(spark):
    rows = [("s1", "abcdef", "", "", "", ""), ("s2", "abcdef", "0", "2", "", "1"), ("s3", "abcdef", "", "", "", "1"), ("s4", "abcdef", "0", "x", "", "0")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "source_id string, text string, target_span_start string, target_span_end string, target_span_text string, toxicity_label string, row_no long")
    assert dict(values(annotate.status(df), "source_id", "status")) == {"s1": "pending", "s2": "complete", "s3": "no_span", "s4": "complete"}
    assert values(annotate.check(df), "rule_id", "key") == [("C05", "s4"), ("C06", "s3"), ("C07", "s4"), ("C10", "s2")]


def test_streams(spark, tmp_path):
    from corpusmill.streaming import leaks as stream

    src = str(tmp_path / "in")
    spark.createDataFrame([("Bad text",), ("fine",)], "text string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000))).write.parquet(src)
    rows = spark.readStream.schema("text string, ts timestamp").parquet(src)
    listed = leakage.exclusion_hashes(spark.createDataFrame([("bad  text!",)], "text string"))
    for name, df, mode, n in (("hits", stream.leaks(rows, listed), "append", 1), ("rate", stream.rates(rows, "ts", "text"), "complete", 2), ("once", stream.first_seen(rows, "ts"), "append", 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() == n


def _brute_candidates(word, sounds, freq, attested):
    """The whole product of a word's options, in order."""
    tone = {c: t for c, _, t in sounds}
    pools = []
    for c in word:
        own = {s for x, s, _ in sounds if x == c}
        alts = [x for x, s, _ in sounds if s in own and x != c and freq.get(x, 0) >= 2]
        pools.append([c, *sorted(alts, key=lambda x: (-freq[x], x))[: maps.PER_POSITION]])
    rows = []
    for made in map("".join, itertools.product(*pools)):
        if made != word:
            same, n = all(tone.get(a) == tone.get(b) for a, b in zip(made, word, strict=True)), attested.get(made, 0)
            grade = maps.GRADES[(0 if same else 2) + (n == 0)]
            rows.append((grade, sum(a != b for a, b in zip(made, word, strict=True)), -n, -min(freq.get(c, 0) for c in made), made))
    return sorted(rows)[: maps.PER_WORD]


def test_word_candidates_of_any_length(spark):
    """Words of 1 to 8 characters, some with few options and some with many, attested ones of all lengths among them."""
    rng = random.Random(4)
    letters = "abcdefghijklmnop"
    sounds = [(c, "s%d" % (i // 5 if i < 10 else 2 + i // 2), "t%d" % rng.randint(0, 1)) for i, c in enumerate(letters)]
    freq = {c: rng.choice([1, 2, 2, 5, 9]) for c in letters[:-1]}
    words = ["".join(rng.choice(letters[10:] if k % 2 else letters) for _ in range(1 + k % 7)) for k in range(40)] + ["opopopop"]
    by_sound = {s: [c for c, x, _ in sounds if x == s] for _, s, _ in sounds}
    attested = {"".join(rng.choice(by_sound[next(s for x, s, _ in sounds if x == c)]) for c in w): rng.randint(1, 9) for w in words * 6}
    got = maps.word_candidates(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(sounds, "char string, syllable string, tone_syllable string"), spark.createDataFrame(list(freq.items()), "char string, count long"), spark.createDataFrame(list(attested.items()), "gram string, n long"))
    found = {}
    for r in got.collect():
        found.setdefault(r.word, []).append((r.confidence, r.n_changed, -r.attested, -r.min_char_freq, r.candidate))
    want = {w: x for w in words if (x := _brute_candidates(w, sounds, freq, attested))}
    assert {w: sorted(x) for w, x in found.items()} == want
    assert any(len(w) > maps.LONGEST for w in want)


def test_nfkc_settled_texts_stay_out_of_python(spark, monkeypatch):
    """Texts of characters that NFKC leaves alone don't reach a worker; all others come out as Python has them."""
    odd = ["ﬁne", "e\u0301", "e\u0300\u0327", "\u1100\u1161\u11a8", "한\u11a8", "Ａ１", "中文，测试", "x²", "½ ª", "क\u093c", "か\u3099", "\U0001d54f", "\u09c7\u09be"]
    plain = ["", "plain", "Größe façade – déjà", "中文。", "ガラス", "한국", "line\nbreak\t", None]
    want = {t: None if t is None else unicodedata.normalize("NFKC", t) for t in [*odd, *plain]}
    rows = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.n for r in rows.select("t", X.nfkc(F.col("t")).alias("n")).collect()} == want
    letters = [chr(c) for a, b in X.settled() for c in {a, (a + b) // 2, b}]
    joined = ["".join(random.Random(k).choices(letters, k=30)) for k in range(200)]
    assert all(unicodedata.is_normalized("NFKC", t) for t in joined)

    @F.pandas_udf("string")
    def none_come(texts: pd.Series) -> pd.Series:
        assert texts.isna().all()
        return texts

    monkeypatch.setattr(X, "_nfkc", none_come)
    told = spark.createDataFrame([(t,) for t in plain], "t string")
    assert {r.t: r.n for r in told.select("t", X.nfkc(F.col("t")).alias("n")).collect()} == {t: t for t in plain}
